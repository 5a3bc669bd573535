"""Imports every module that registers queries."""

from orevein.plans import breadth_queries, document_queries, entity_queries, metadata_queries, pipeline_queries, search_queries, text_queries, understanding_queries  # noqa: F401
