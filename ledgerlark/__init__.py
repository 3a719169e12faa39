"""A PySpark-native engine for building, validating and scoring numerical question sets over financial tables."""
