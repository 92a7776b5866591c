"""Readers and writers for lineage, catalog and documentation records."""
