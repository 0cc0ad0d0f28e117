"""Spark-native retrieval, usage analytics and corpus processing."""
