"""PySpark-native labeling and training-data engine."""
