"""Expressions: selectors, aggregates, positional functions and scalar helpers."""
