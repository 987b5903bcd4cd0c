"""Training-data operators on the tables `documents`, `pages` and `labels`.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
