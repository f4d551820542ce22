"""lexfreq: vocabulary-frequency analytics on Spark DataFrames."""
