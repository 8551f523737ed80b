"""geoloom: location mining and training-data preparation on Spark DataFrames."""
