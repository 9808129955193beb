"""Queries that show every operator on the generated test tables, and their SQL counterparts."""
