"""Column expressions: exact fixed-point numbers, symbols and labels."""
