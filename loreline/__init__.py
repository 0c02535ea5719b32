"""loreline: a PySpark-native analytics engine for source-code and text corpora."""
