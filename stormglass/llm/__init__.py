"""Operators for preparing language-model training data.

Nothing else in the library imports this package. `queries.py` registers one query for
each operator; the operators themselves keep general interfaces.
"""
