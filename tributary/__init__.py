"""Lineage and code-graph analytics on Spark."""
