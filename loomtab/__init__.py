"""Spark-native web-table, knowledge-graph and data-preparation operators."""
