"""Spark-native retrieval over versioned document collections."""
