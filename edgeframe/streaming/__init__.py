"""Incremental analysis: caches, change streams and their batches."""
