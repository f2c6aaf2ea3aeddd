"""Queries over the shared tables, with the SQL they are checked against."""
