"""Marts and governance queries: lazy compositions over named frames."""
