"""Document-integrity analytics over tables of many documents, on Spark DataFrames."""
