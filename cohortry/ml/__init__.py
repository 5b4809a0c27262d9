"""Ensemble learning on Spark ML."""
