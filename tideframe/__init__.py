"""Deterministic market-data analytics on Spark."""
