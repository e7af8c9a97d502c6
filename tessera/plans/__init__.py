"""Queries over the driver's tables; importing the package registers them all."""

from . import detail_queries, document_queries, event_queries, extension_queries, graph_queries, io_queries, link_queries, more_queries, scope_queries, text_queries, source_queries  # noqa: F401
