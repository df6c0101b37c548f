"""Spark-native evidence consolidation: sources, claims, decisions and documents as DataFrames."""

__version__ = "0.1.0"
