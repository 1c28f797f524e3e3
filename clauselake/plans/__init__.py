"""Whole flows built from the operators."""
