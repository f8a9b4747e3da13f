"""foliospark: a PySpark-native engine for harvesting, reshaping and unifying bibliographic data."""
