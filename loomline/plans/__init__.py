"""Queries over the driver's tables, each with its SQL twin, and the end-to-end retrieval plan."""
