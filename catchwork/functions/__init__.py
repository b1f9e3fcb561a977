"""Column expressions: numbers, text, hydrology, geometry."""
