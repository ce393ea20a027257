"""heaplens: heap-snapshot analytics expressed as Spark DataFrames."""
