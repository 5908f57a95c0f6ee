"""Readers, writers and the inputs derived from the driver tables."""
