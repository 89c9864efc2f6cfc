"""newsloom: feed, document and training-corpus analytics on Spark DataFrames."""
