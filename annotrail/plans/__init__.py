"""Codebooks, coding runs and their lineage."""
