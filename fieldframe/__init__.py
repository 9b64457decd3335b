"""fieldframe: image, raster and field-plot analytics on Spark DataFrames."""
