"""Readers, writers and the example tables."""
