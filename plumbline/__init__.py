"""Spark-native analytics engine: DataFrame, SQL and Structured Streaming forms of the takeoff operators."""
