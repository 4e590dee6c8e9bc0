"""Operators for large text corpora used as model training data.

Nothing else in the library imports this subpackage.
"""
