"""Spark-native claims analytics and training-data operators."""
