"""Queries over the tables, each beside the SQL that gives the same rows."""
