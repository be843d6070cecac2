"""A PySpark-native engine for text corpora and subword vocabularies."""
