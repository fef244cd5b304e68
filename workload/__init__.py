"""Registered queries: corpora rendered from the given tables, Spark queries and their SQL counterparts."""
