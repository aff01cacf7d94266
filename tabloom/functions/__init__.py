"""Column expressions (A1 references, values, symbols) and the formula language."""
