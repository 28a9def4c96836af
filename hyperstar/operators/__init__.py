"""Operators of the query interface."""
