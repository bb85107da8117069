"""Column functions: text, dates, numbers, arrays."""
