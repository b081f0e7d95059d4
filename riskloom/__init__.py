"""Spark-native engine for transaction-network risk analysis."""
