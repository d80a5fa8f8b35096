"""Readers and writers of memory records."""
