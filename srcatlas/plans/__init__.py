"""Ready-made jobs over the given tables."""
