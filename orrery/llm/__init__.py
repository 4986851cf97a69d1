"""Operators for language-model training data: evaluation leaks, source mixtures, reading levels.

Nothing else in the library imports this subpackage.
"""
