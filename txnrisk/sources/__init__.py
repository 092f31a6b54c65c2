"""Readers, writers and the canonical frames built on the star-schema tables."""
