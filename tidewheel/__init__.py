"""Frontier analytics on Spark: crawl-style dataflow declared on DataFrames."""

__version__ = "0.1.0"
