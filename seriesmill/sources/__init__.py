"""Panels built from relational tables."""
