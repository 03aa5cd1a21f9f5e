"""The named queries over the reference's own operators, and SQL for those that SQL can express."""

from __future__ import annotations

from weftline.plans import diff_queries, graph_queries, registry_queries, state_queries, target_queries

QUERIES = {**diff_queries.QUERIES, **graph_queries.QUERIES, **state_queries.QUERIES, **target_queries.QUERIES, **registry_queries.QUERIES}
ORACLE_SQL = {**diff_queries.SQL, **graph_queries.SQL, **state_queries.SQL, **target_queries.SQL, **registry_queries.SQL}
