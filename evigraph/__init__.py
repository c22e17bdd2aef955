"""evigraph: a Spark-native engine for dated, sourced assertion graphs."""

__version__ = "0.1.0"
