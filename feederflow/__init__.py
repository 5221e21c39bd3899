"""feederflow: a Spark-native engine for electricity-network analytics."""
