"""Clauselake: Spark operators for corpora of legal and privacy documents."""

__version__ = "0.1.0"
