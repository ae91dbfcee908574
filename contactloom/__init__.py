"""Contact extraction over tables and streams of fetched pages, on Spark DataFrames."""
