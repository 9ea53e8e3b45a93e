"""larkspur: a PySpark-native retrieval and text-analytics engine."""
