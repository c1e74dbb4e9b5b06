"""Pipelines and the query registry."""
