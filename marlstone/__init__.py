"""A Spark-native engine for caption assembly, caption evaluation and corpus preparation."""
