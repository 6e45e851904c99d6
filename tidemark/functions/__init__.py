"""Column expressions: symbols, flags, trading rules, clocks and text classes."""
