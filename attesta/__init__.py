"""Entity-resolution benchmarks and training-data operators on Spark DataFrames."""
