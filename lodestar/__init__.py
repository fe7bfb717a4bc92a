"""lodestar: source-tree analytics expressed as Spark DataFrames."""
