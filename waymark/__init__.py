"""Linear-reference, network, raster-tile and corpus analytics on Spark DataFrames."""
