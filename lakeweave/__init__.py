"""Joinable column discovery and training-data operators on Spark."""
