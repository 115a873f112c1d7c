"""floorgraph: indoor-map and navigation-graph analytics on Spark DataFrames."""
