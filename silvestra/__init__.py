"""Tree-shaped document analytics expressed as Spark DataFrames."""
