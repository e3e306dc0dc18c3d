"""Bitemporal, branch-aware knowledge analytics on plain Spark plans."""
