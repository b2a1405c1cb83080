"""souqframe: a PySpark-native engine for messy marketplace listings and training-data preparation."""
