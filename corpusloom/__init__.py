"""Spark-native corpus perturbation, experiment metrics and training-data operators."""
