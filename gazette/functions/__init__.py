"""Column functions: text, parsing, keys, molecules, presentation."""
