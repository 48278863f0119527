"""palimpsest: a PySpark-native engine for conversational memory and message analytics."""
