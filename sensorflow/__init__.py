"""Config-driven sensor processing on Spark DataFrames and Structured Streaming."""
