"""Spark operators for analysing generated tests and the code they cover."""

__version__ = "0.1.0"
