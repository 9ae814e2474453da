"""Operators for preparing training text: deduplication, sharding, scoring, scanning, tokenising."""
