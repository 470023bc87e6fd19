"""Coding of streams."""
