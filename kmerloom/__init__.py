"""kmerloom: Spark-native analytics over colored, linked de Bruijn graphs."""

__version__ = "0.1.0"
