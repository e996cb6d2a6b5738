"""Verdict analytics on Spark: scoring, committees, gates, drift and diff of judge verdict tables."""
