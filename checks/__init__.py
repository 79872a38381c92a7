"""Queries over the driver's tables, each with the SQL that has to give the same rows."""
