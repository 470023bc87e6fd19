"""Relational and statistical operators over ratings."""
