"""Operators for preparing language-model training data on Spark.

Nothing outside this package imports it.  Each operator module holds a general
operator and one thin ``opN_*`` query that applies it to its whole table.
"""
