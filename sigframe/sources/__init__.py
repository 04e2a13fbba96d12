"""Readers, parsers and the upserted archive."""
