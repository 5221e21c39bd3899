"""Readers and writers of network descriptions."""
