"""Column functions: each takes and returns Spark columns, none is a UDF."""
