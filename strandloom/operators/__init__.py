"""Relational operators: joins, set algebra, windows, scores, balanced aggregation."""
