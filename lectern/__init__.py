"""lectern: a PySpark-native archive analytics and retrieval engine."""
