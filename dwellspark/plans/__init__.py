"""Queries over the project's tables, each with its SQL."""
