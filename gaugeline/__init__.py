"""Gaugeline: retrieval measurement and evaluation-set auditing as Spark plans."""

__version__ = "0.1.0"
