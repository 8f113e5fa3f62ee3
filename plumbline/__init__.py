"""PySpark-native research analytics over daily price bars, and training-data operators."""

__version__ = "0.1.0"
