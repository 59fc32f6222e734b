"""Relational operators over records: newest, compared, counted."""
