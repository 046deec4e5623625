"""Operators of a training-data pipeline: deduplication, filtering, scoring, packing, archives."""
