"""Spark-native operators for entity time series: gap-aware shaping, robust peer comparison, monitoring and event tests."""
