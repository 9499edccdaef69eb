"""Readers and writers of the corpus formats."""
