"""Cohort analytics as Spark DataFrame operators."""
