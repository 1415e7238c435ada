"""A Spark-first engine for raster time series, expressed as DataFrame plans."""

__version__ = "0.1.0"
