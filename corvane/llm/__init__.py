"""Operators of a training-data pipeline: formatting, extraction, deduplication, scoring, search and output."""
