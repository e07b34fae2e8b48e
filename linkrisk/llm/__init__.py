"""Operators for building text corpora for language-model training.

Nothing else in the package imports this subpackage; it can be deleted as a whole.
"""
