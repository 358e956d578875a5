"""gleaner: transcript-knowledge analytics on Spark DataFrames."""
