"""Spark-native document analytics: DataFrame-to-DataFrame operators and named queries over them."""
