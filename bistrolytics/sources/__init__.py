"""Readers, catalog maintenance and published artifacts."""
