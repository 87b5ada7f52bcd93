"""Column functions: text, vectors, statistics."""
