"""Spark-native analysis of long multi-night physiological recordings."""
