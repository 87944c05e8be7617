"""Document-evidence analytics written directly on Spark DataFrames."""
