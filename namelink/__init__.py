"""namelink: record linkage of organisation names on Spark."""
