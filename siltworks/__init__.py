"""Spark-native curation and analytics engine: every operator is a DataFrame plan."""
