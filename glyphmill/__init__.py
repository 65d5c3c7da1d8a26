"""A Spark-native text tokenization engine."""
