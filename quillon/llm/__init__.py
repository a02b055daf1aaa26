"""Operators for building training corpora from a table of documents.

Nothing else in the library imports this subpackage.
"""
