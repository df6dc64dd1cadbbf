"""Operators for preparing training corpora, each one distributed Spark job."""
