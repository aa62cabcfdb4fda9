"""Readers and writers of review files, feeds, pages and databases."""
