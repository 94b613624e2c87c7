"""Change-history risk analytics as plain DataFrame-to-DataFrame functions on Spark."""

__version__ = "0.1.0"
