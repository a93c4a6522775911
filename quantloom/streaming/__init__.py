"""Continuous versions of a few operators."""
