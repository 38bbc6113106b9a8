"""A Spark-native engine for conversations and text corpora."""
