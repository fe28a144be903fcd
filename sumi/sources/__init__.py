"""Rasters, images and cached results as DataFrames."""
