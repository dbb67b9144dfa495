"""PySpark-native engine for supplier catalogues, trade rules and training-data preparation."""
