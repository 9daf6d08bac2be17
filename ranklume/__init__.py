"""A Spark-native engine for candidate-ranking pipelines."""
