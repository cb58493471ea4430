"""Incremental (Structured Streaming) maintenance of accumulating facts."""
