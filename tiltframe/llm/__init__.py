"""Operators for preparing training text: formatting, extraction, deduplication, scoring, packing."""
