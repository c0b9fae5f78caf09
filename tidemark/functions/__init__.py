"""Column expressions: text, identifiers, keys, presentation."""
