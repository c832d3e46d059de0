"""Spark-native analytics for phylogenomic sequence data."""
