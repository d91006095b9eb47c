"""Whole operations: unrolling and parsing, their nested form, SQL names."""
