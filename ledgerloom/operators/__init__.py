"""Relational operators: deduplication, skew-aware joins, decontamination, sampling, facts, statistics."""
