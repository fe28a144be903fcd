"""Operators on pixel tables and box tables (SQL) and on whole rasters (Arrow)."""
