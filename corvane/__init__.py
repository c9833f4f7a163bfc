"""Corvane: a Spark-native semantic index with retrieval evaluation."""

__version__ = "0.1.0"
