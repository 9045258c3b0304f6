"""Scans: instance tables, options and row-index files."""
