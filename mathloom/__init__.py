"""Curation and scoring of formula-recognition corpora as Spark jobs."""
