"""Operators for preparing training data: scoring, filtering, deduplication, decontamination, tokens and archives."""
