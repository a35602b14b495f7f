"""planwise: Spark-native query statistics, cardinality and cost estimation, and plan analytics."""
