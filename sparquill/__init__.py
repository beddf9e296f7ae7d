"""Spark-native plan selection, log analytics and large-table data processing."""
