"""Portfolio analytics over source repositories, expressed as Spark DataFrames."""
