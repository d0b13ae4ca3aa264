"""Readers, writers and fixed dimension tables."""
