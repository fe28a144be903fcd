"""Raster, glyph and batch-pipeline analytics on Spark DataFrames."""
