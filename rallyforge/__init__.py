"""rallyforge: a Spark-native engine for court-movement data and training-data preparation."""

__version__ = "0.1.0"
