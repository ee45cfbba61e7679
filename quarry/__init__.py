"""Text-corpus and source-code analytics on Spark DataFrames."""
