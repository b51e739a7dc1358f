"""Operators for training-data pipelines: scans, near-duplicates, formatting, scoring, mixing."""
