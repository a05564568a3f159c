"""Relational operators over history, star and blob tables."""
