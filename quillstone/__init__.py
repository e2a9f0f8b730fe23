"""Spark-first analytics over cited evidence: blocks, profiles, consensus, coverage."""

__version__ = "0.1.0"
