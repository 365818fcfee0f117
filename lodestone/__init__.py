"""Lodestone: a Spark-native retrieval and corpus-preparation engine."""
