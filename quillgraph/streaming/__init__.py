"""Incremental maintenance from streams."""
