"""terrascape: algorithm-performance landscapes on Spark DataFrames."""
