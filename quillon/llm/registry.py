"""The queries of this folder, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_topk": "topk",
    "op2_packing": "packing",
    "op3_quality": "quality",
    "op4_secrets": "secrets",
    "op5_neardup": "neardup",
    "op6_mixing": "mixing",
    "op7_language_id": "langid",
    "op8_toxicity": "toxicity",
    "op9_fingerprint": "fingerprint",
    "op10_repeats": "repeats",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_topk"] = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
