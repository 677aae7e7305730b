"""Spark-native image, region, contour and signal analytics."""
