"""Legal-corpus retrieval and obligation engine on Spark DataFrames."""
