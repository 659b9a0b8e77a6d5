"""Building blocks: DataFrames in, DataFrames out, every repository at once."""
