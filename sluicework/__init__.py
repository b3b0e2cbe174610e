"""Sluicework: Spark-native ingestion, feature engineering and entity analytics."""

__version__ = "0.1.0"
