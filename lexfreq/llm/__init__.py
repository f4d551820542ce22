"""Operators of a training-data pipeline, each over whole tables."""
