"""corpusweave: a PySpark-native engine for licence-compliance text analytics."""
