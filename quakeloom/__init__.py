"""Spark-native analytics for bitemporal event catalogs and point-process forecasts."""
