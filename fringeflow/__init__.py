"""Spark-native analytics for keyed, time-indexed measurements with spectra, flags and weights."""

__version__ = "0.1.0"
