"""Retrieval, curation and evaluation of text corpora as Spark DataFrame programs."""
