"""Relational operators: dedupe, matching, survivorship, upsert."""
