"""Composed plans: the repository and the query catalogue."""
