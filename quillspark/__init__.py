"""Spark-first engine for correcting, measuring and restructuring recognised text."""
