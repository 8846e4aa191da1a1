"""Spark-native extraction of clean, named, geotagged view datasets from panoramic and flat frames."""
