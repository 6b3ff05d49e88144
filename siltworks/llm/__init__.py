"""Operators of a training-data pipeline: dedup, extraction, classification, tokens, chat."""
