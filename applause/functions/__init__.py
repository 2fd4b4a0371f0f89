"""Column functions: text, values and the fixed word lists."""
