"""tesselon: a Spark-native engine for user-item interaction data and training-data preparation."""

__version__ = "0.1.0"
