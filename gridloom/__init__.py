"""Time-series and gridded-array analytics on Spark DataFrames."""
