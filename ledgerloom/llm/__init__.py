"""Operators for training-data pipelines: deduplication, mixing, search, scoring.

Nothing outside this folder imports it; the folder can be deleted as a whole.
"""
