"""Spark-native document translation dataflow and corpus operators."""
