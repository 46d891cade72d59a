"""Operators for preparing training corpora, each a DataFrame -> DataFrame function.

Nothing else in the package imports this subpackage.
"""
