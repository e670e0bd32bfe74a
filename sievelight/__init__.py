"""Spark-native evidence retrieval and corpus analytics."""
