"""Spark-native raster, annotation and corpus analytics."""

__version__ = "0.1.0"
