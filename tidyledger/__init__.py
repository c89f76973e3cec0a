"""Cleaning, de-duplicating and analysing messy tabular records on Spark."""

__version__ = "0.1.0"
