"""Loomgraph: a Spark-native engine over conversation logs, their knowledge graph and their search indexes."""
