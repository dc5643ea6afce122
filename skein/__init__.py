"""skein: property-graph analytics of software systems on Spark DataFrames."""
