"""Column expressions: text, hashing, scoring."""
