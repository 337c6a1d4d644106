"""Operators for preparing large text corpora.

Each module holds one operator, built as a Spark job; ``queries`` holds the thin
queries that apply them to the project's tables.  Nothing outside this
subpackage imports it.
"""
