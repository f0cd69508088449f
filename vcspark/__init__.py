"""vcspark: a PySpark-native analytics engine for visual-commerce and corpus data."""
