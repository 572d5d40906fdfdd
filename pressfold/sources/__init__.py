"""Readers of the catalogue's tables and of page files."""
