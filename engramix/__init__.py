"""Engramix: a PySpark-native engine for storing, searching and maintaining a corpus of text memories."""
