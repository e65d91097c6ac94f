"""Readers of raw files and writers of tables."""
