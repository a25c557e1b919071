"""Column expressions: text, label, vector and bitmap functions."""
