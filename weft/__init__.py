"""weft: graph analytics on Spark DataFrames."""
