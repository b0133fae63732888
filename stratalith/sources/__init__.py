"""Scans: directory trees, binary index files, deterministic generators."""
