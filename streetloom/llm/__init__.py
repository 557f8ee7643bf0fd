"""Operators for preparing language-model training data.

Nothing else in :mod:`streetloom` imports this subpackage.
"""
