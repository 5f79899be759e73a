"""strandlake: a Spark-native engine for sequence corpora and token-generation experiments."""

__version__ = "0.1.0"
