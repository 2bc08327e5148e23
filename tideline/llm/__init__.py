"""Operators for preparing training data: one module per operator.

Nothing outside this package imports it.  ``queries`` holds the registered
queries, ``common`` the Spark and text helpers that the operators share.
"""
