"""Composed plans over the given tables: fixture derivations, manifest assembly, the query registry."""
