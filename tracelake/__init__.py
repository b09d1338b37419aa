"""Span-table analytics on Spark: build, encode, lay out, verify and profile trace spans."""

__version__ = "0.1.0"
