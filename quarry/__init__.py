"""Quarry: a Spark-native analytics engine for property graphs of software projects."""
