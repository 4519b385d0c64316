"""Operators of a training-data pipeline: sharding, filters, deduplication, formatting, packing."""
