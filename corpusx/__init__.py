"""corpusx: text-corpus analytics on Spark DataFrames."""
