"""Spatial measurement analytics on Spark: DataFrame operators, sources, functions, plans and streams."""
