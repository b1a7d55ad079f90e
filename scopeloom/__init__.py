"""Spark-native operators for project documents, scope items and bids."""
