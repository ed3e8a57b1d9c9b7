"""Cloud geospatial catalogs and GeoParquet as Spark DataFrames."""
