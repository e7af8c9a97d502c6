"""Spark-native analytics over fact graphs, documents and event logs."""
