"""weft: kernel, graph, spectral and record analytics as Spark DataFrames."""

__version__ = "0.1.0"
