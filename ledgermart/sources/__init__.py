"""Declared schemas, typed loading and writes, and the test-table views."""
