"""Spark-native chat-safety analytics and training-corpus operators."""
