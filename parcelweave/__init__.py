"""Record extraction, cleansing, upsert, frontier and monitoring operators on Spark DataFrames."""
