"""Column to column functions: no data frame, no shuffle."""
