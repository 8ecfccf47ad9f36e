"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; ``queries.py`` holds its
registered queries and ``oracles.py`` the SQL that some of them can be checked against.
"""
