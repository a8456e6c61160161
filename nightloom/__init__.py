"""Sky-frame and text-corpus jobs expressed as Spark DataFrames."""
