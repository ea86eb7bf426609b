"""Analytics engineering on Spark: explore, query, transform and maintain tables."""

__version__ = "0.1.0"
