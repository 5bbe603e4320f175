"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and returns a DataFrame; ``queries`` holds the registered queries and their SQL.
"""
