"""Relational plans and the registered queries."""
