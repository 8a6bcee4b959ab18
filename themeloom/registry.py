"""All queries of the core and their oracle SQL."""

from __future__ import annotations

from .plans import catalog, io_queries, kb_queries, knowledge, page_queries, sql, text_queries, topic_queries  # noqa: F401  importing the query modules registers their queries

QUERIES = {**knowledge.QUERIES, **catalog.QUERIES}
ORACLES: dict[str, str] = {"p1_found": sql.P1, "p1_tables": sql.P1_TABLES, "p1_nodes": sql.P1_NODES, "p7_cycles": sql.P7_CYCLES, "p7_found": sql.P7, "p7_paths": sql.P7_PATHS, "p7_descendants": sql.P7_DESCENDANTS, **catalog.ORACLES}
