"""keepstone: a PySpark-native engine for curating large collections of records."""
