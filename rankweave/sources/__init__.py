"""Readers, schema repair and table writers."""
