"""PySpark-native analytics for document collections and evidence retrieval."""
