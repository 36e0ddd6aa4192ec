"""A PySpark-native analytics engine for pan-genome data, and operators for training data."""
