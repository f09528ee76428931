"""Point-in-time research over versioned series, expressed as Spark DataFrames."""
