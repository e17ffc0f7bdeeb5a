"""A Spark-native store and query engine for graph-shaped data."""
