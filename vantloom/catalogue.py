"""Importing this module registers every query of the library."""

from vantloom.plans import record_queries, stream_queries, text_queries, vector_queries  # noqa: F401
