"""Operators for preparing training text: filters, near-duplicates, scans, models and token files."""
