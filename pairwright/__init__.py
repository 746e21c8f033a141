"""pairwright: a Spark-native engine for paired evaluation data and corpus operators."""

__version__ = "0.1.0"
