"""codegauge: quality analytics for large tables of source-code snippets, on Spark."""

__version__ = "0.1.0"
