"""Document analytics on Spark: operators, sources, functions, plans and streams."""
