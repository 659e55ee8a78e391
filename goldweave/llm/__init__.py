"""Operators of a training-data pipeline: scoring, deduplication, classification, masking, encoding."""
