"""Registered queries: library calls on the given tables, with their SQL twins."""
