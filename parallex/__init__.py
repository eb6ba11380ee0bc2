"""parallex: Spark-native analytics over bilingual documents."""
