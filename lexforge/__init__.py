"""A PySpark-native engine for versioned text corpora."""
