"""Queries registered for the driver: each binds operators to the given tables, with the SQL that
must give the same rows."""
