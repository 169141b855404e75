"""Column-expression helpers shared by the operators (built-in functions only)."""
