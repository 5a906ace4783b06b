"""cartolode: repository analytics over Spark DataFrames."""
