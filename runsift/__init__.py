"""runsift: records of automated test-generation and evaluation runs as Spark DataFrames."""
