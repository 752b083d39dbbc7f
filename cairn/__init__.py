"""Record and document analytics written for Spark DataFrames, Spark SQL and Structured Streaming."""
