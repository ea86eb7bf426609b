"""Profiling, keys, joins, ranking, diagrams, clusters and drift."""
