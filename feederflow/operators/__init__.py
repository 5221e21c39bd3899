"""Operators on networks: checks, topology, accounting, reductions."""
