"""Fixed word lists, patterns and tables used as operator defaults."""
