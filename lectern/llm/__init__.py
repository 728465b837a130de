"""Operators for preparing language-model training data.

Nothing else in the library imports this package.  Every operator takes and
returns DataFrames; ``queries.py`` applies each to its whole table.
"""
