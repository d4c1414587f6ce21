"""Column expressions; none is a UDF."""
