"""Readers and writers."""

from themeloom.sources.matrices import read_matrix, read_matrix_rows, read_vector, write_matrix_rows
from themeloom.sources.tables import save_tables
from themeloom.sources.text import read_lines
from themeloom.sources.triplets import check_document_count, nested_documents, read_triplets

__all__ = [
    "check_document_count",
    "nested_documents",
    "read_lines",
    "read_matrix",
    "read_matrix_rows",
    "read_triplets",
    "read_vector",
    "save_tables",
    "write_matrix_rows",
]
