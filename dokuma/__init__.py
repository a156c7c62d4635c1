"""dokuma: a PySpark-native engine for building and querying training corpora."""
