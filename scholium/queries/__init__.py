"""The engine's own queries: name -> (spark, sf_dir) -> DataFrame, and their SQL twins."""

from __future__ import annotations

from . import academic, catalog, citations, documents, evaluation, memory, relational, retrieval, sources, streams

QUERIES: dict = {}
QUERY_SQL: dict = {}
for _module in (retrieval, documents, evaluation, memory, catalog, citations, academic, sources, streams, relational):
    QUERIES.update(_module.QUERIES)
    QUERY_SQL.update(_module.QUERY_SQL)

FLAGSHIP = "bm25_topk"
