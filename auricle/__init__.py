"""Data work around event detection, written as PySpark DataFrame operators."""

__version__ = "0.1.0"
