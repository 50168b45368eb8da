"""Composed queries: hybrid search and the table of registered queries."""
