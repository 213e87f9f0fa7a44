"""Spark-native analytics over a corpus of interlinked documents."""
