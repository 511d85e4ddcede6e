"""Schema documents to graphs, and training-text operators, on Spark DataFrames."""
