"""PySpark-native cataloguing engine for large collections of binary and text assets."""
