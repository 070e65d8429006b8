"""Spark-first engine for chunking, searching, scoring and auditing text corpora."""
