"""Canonical views over tables."""
