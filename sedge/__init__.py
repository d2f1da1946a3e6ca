"""A Spark-native engine for retrieval analytics."""
