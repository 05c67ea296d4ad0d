"""quarry: a Spark-native engine for evaluating anomaly scores kept as tables."""
