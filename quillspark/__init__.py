"""A Spark-native engine for infill corpora, completion scoring and training-text preparation."""
