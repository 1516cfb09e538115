"""Operators of a training-data pipeline: mixing, deduplication, tokenising, classifying, extraction, scoring, redaction.

Nothing else in the library imports this subpackage.
"""
