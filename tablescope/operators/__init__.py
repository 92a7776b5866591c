"""Operators over metadata, lineage and table frames."""
