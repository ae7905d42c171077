"""gleaner: a Spark-native engine for document analytics, retrieval and evidence selection."""

__version__ = "0.1.0"
