"""Document cataloguing and corpus preparation on Spark DataFrames."""
