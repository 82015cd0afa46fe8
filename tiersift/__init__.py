"""A PySpark-native engine for hierarchical retrieval over document corpora."""
