"""A PySpark-native engine for DNA sequencing data."""
