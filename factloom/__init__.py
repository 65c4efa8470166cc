"""Spark-native analytics for company fundamentals: operators are lazy DataFrame -> DataFrame functions."""
