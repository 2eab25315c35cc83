"""PySpark-native document extraction engine."""
