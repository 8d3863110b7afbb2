"""A PySpark-native analytics library for aviation data."""
