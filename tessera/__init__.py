"""A PySpark-native engine for districting analytics."""
