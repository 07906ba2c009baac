"""Operators of a training-data pipeline: search, cleaning, scoring, tokens and packing."""
