"""A PySpark-native analytics engine: auction-stream queries, batch graph and text workloads, and their operators."""
