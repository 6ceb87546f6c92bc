"""Spark-native statistics: regression, tests and diagnostics as DataFrame functions and SQL."""
