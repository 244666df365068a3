"""Registered queries: each binds one operator to the given tables."""
