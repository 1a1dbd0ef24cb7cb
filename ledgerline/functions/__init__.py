"""Column expressions: versions, names and text, column types."""
