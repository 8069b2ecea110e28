"""Incremental (batch) processing: skip what is already in the target, append the rest."""
