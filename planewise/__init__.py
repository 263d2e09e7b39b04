"""Analytics of how far a planar projection of high-dimensional data can be trusted, on Spark DataFrames."""
