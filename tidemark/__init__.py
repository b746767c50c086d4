"""Spark-native analytics for irregular time series; every operator is a lazy DataFrame -> DataFrame function."""
