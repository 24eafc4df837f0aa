"""Corpus redaction and audit as Spark jobs."""
