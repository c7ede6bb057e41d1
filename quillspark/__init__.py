"""A Spark-native engine for versioned document corpora."""
