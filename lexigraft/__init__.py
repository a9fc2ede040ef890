"""Alignment of coded vocabularies and annotated text to a target ontology, on Spark."""
