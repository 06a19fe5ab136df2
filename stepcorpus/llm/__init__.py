"""Operators of a training-data pipeline over text tables (documents, pages, benchmark, labels).

Nothing else in the library imports this subpackage; ``queries`` holds the
thin ``opN_`` queries and their SQL.
"""
