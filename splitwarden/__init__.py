"""Auditable machine-learning data workflows on Spark."""

__version__ = "0.1.0"
