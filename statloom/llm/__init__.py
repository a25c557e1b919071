"""Operators for preparing training data: rules, deduplication, redaction, extraction, tokens, packing."""
