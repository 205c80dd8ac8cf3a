"""A PySpark-native engine that queries data together with its metadata."""
