"""Registered queries, by area; each module has QUERIES and ORACLE."""
