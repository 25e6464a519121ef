"""Readers, writers and the column-role mapping."""
