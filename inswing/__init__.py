"""Ball-by-ball analytics as whole-population Spark DataFrames."""
