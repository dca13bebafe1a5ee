"""Effect-coefficient analytics on Spark DataFrames."""
