"""Column functions: row-local, built from Spark's own expressions."""
