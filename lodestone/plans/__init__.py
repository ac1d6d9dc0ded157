"""Registered queries: library operators bound to the given tables."""
