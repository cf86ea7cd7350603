"""Document preparation, usage analytics, validation and build planning on Spark DataFrames."""
