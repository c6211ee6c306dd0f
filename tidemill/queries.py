"""Registry of the reference's own operators: name -> (query, SQL)."""

from __future__ import annotations

from .plans import guideline_queries, model_queries, table_queries, text_queries  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "corpus_source_stats"
