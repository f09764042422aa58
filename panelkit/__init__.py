"""Survey-panel response analytics on Spark DataFrames."""
