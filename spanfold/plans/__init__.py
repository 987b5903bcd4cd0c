"""Whole plans: harvest documents and the aggregator."""
