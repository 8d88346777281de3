"""A lazy table and column engine whose operators compile to Spark DataFrame expressions."""
