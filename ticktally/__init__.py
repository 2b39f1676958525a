"""Spark-native request-metrics reports and the data-processing operators around them."""
