"""End-to-end evaluations and the bindings to the given tables."""
