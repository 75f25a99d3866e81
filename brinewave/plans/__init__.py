"""Jobs put together from the operators, and the queries on the given tables."""
