"""A Spark-native query engine for append-only ledgers."""
