"""citeloom: a Spark-native engine for citation analytics over scholarly text."""
