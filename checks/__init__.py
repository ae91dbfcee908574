"""Inputs derived from the given tables, and the SQL that results are checked against."""
