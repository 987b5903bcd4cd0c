"""Structured Streaming form of the aggregator."""
