"""docloom: a Spark-native document-structure quality engine."""
