"""Column builders: pure expressions without a shuffle."""
