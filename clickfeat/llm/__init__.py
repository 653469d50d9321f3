"""Operators for preparing training text: scoring, mixing, scanning, deduplication (see README, section llm)."""
