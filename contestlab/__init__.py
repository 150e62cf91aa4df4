"""contestlab: leakage-free analytics for two-sided contests on Spark DataFrames."""
