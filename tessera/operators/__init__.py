"""Verbs on frames."""
