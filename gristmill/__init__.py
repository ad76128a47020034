"""PySpark-native retrieval, link analysis and text-corpus operators."""
