"""A PySpark-native engine for text analytics and kernel-based retrieval."""
