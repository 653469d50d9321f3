"""Column functions built from Spark built-ins (no Python UDF)."""
