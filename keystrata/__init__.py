"""Analytics over multi-version, range-partitioned key histories, on Spark DataFrames."""
