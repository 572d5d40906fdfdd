"""Streams of page files."""
