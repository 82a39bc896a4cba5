"""A Spark-native engine for document processing and hybrid retrieval."""
