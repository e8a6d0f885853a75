"""Spark-native analytics for all-versus-all similarity search."""
