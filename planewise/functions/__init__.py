"""Column builders: row transforms of vectors and pair metrics."""
