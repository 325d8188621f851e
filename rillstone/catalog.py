"""All registered queries and their SQL twins."""

from .operators import fingerprint, gates, ingest, jobs, lifecycle, messages, registry, retrieval, rules, scans, signal, similarity, topk  # noqa: F401  (they register themselves)
from .sources import incremental  # noqa: F401
from .streaming import timers  # noqa: F401
from .plans.registry import oracle_queries, spark_queries

QUERIES = spark_queries()
ORACLE = oracle_queries()
