"""Entity resolution and master-data management on Spark DataFrames."""
