"""A Spark-native engine for text-generation experiments, vocabulary data and training-data corpora."""
