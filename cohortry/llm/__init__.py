"""Operators for building training data: one module each, queries in ``queries``."""
