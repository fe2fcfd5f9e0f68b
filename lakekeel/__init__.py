"""lakekeel: placement and chunk-lifecycle analytics on Spark DataFrames."""
