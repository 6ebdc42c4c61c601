"""A Spark-native engine for full-text search and corpus analytics."""
