"""Market-microstructure analytics on Spark DataFrames."""
