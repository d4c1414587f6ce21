"""Operators on facts, documents and their lineage."""
