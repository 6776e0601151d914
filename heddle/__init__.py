"""heddle: change-set, finding and feedback analytics over Spark DataFrames."""
