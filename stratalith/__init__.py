"""Stratalith: content-addressed analytics as DataFrame transformations."""
