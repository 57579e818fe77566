"""A Spark-native analytics engine for deduplicated snapshot data."""
