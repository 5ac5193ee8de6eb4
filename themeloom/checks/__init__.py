"""Registered queries over the given tables and the SQL each is checked against."""
