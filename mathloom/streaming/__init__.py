"""Incremental curation."""
