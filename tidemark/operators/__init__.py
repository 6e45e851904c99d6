"""Table operators, grouped by subject."""
