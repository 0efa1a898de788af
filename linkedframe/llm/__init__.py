"""Operators for preparing text corpora, each a plain function from DataFrames to a DataFrame.

Nothing outside this subpackage imports it.  ``queries`` holds the registered queries and their SQL.
"""
