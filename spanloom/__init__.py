"""Trace, call-graph and lineage analytics on Spark."""
