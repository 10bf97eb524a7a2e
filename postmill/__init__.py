"""Brand monitoring on Spark: sources, predicates, reports, history and streams."""
