"""Registered queries: each applies operators of this library to the given tables, beside the SQL it is checked against."""
