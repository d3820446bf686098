"""quire: a PySpark-native analytics engine for digitised-text collections."""
