"""Readers, writers and format conversions."""
