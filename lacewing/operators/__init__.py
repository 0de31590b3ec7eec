"""Relational and numerical operators."""
