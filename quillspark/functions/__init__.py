"""Column functions: text, similarity, scores, dates. All are built from Spark's own expressions."""
