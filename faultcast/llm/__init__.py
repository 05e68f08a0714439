"""Operators of a training-data pipeline: dedup, quality, decontamination, mixing, archives."""
