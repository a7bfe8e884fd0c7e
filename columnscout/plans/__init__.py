"""Pipelines made of several operators, lineage helpers and the query registry."""
