"""Drift analytics on Spark."""
