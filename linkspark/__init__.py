"""linkspark: entity-resolution blocking and corpus preparation on Spark DataFrames."""
