"""Event-election analytics on Spark: DataFrame operators, sources, functions and plans."""
