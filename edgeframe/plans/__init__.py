"""Composed plans: the public API and the registered queries."""
