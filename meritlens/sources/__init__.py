"""Readers, writers and record schemas."""
