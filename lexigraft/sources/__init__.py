"""Readers and writers of the file formats, each with an explicit schema."""

from .annotated import read_bioc, read_pubtator
from .documents import read_documents, write_documents, write_summary, write_table
from .vocabulary import read_reference_set, read_rrf, vocabulary_tables

__all__ = ["read_bioc", "read_documents", "read_pubtator", "read_reference_set", "read_rrf", "vocabulary_tables", "write_documents", "write_summary", "write_table"]
