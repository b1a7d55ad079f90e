"""Iterative table algorithms."""
