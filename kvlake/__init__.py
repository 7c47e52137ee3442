"""kvlake: token-scoped key-value data as Spark tables."""
