"""Raster, polygon and catalog analytics as lazy Spark plans."""
