"""meetspark: Spark-native analytics over collections of conversation recordings."""
