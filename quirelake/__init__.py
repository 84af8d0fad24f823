"""A PySpark-native analytics engine for document-derived tabular data."""
