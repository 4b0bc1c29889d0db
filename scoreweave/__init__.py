"""Analytics over sparse entity x metric score matrices, on Spark DataFrames."""
