"""Joins, data-quality checks, history maintenance and derivations."""
