"""Time-aware outcome analysis over registry records, and corpus operators, as lazy Spark DataFrames."""
