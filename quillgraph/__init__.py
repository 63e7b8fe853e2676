"""Logical queries over knowledge graphs, answered by Spark plans."""
