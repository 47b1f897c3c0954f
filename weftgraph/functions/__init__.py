"""Column functions: text, vectors, json, cost."""
