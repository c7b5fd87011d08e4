"""Fixture views, queries over the given tables, and the equal SQL."""
