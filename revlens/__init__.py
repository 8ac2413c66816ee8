"""Analytics over the edit histories of documents, built on Spark DataFrames."""
