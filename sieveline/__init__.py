"""Spark-native ticket retrieval: filter language, TF-IDF search, routing, row-level access, answer validation."""
