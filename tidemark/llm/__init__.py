"""Training-data operators: one module each, all working on Spark DataFrames."""
