"""Column expressions: every function takes and returns Spark columns, with no Python UDF."""
