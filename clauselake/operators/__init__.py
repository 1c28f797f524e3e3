"""Data frame to data frame operators."""
