"""A PySpark-native engine for text retrieval over sparse two-dimensional fingerprints."""
