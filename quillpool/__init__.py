"""Spark-first engine for pool-based active learning and text-classification analytics."""
