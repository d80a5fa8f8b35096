"""Operators for building training data from a document corpus.

Nothing outside this package imports it. Each module holds one operator with
its own general interface; ``queries`` binds them to the tables.
"""
