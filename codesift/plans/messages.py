"""Queries on messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from codesift.operators.delivery import STAND_INS, SeenStore, delivered, message_key, repeated
from codesift.runtime import scratch
from codesift.sources.tables import table
from codesift.streaming import events as streams


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated(table(spark, folder, "pull_requests"))


def p7_delivered(spark: SparkSession, folder: str) -> DataFrame:
    return delivered(table(spark, folder, "pull_requests"))


def p7_stream(spark: SparkSession, folder: str) -> DataFrame:
    """How often a stream over the queue hands on each message: once, whatever the order of its files.

    The queue is staged as files of eight ranges of ``batch_id``; a trigger takes two of them.
    """
    queue = table(spark, folder, "pull_requests")
    staged = f"{scratch(spark, 'queue')}/pull_requests.parquet"
    queue.select("msg_id", "batch_id", "received_at", "number", "repo_name", "head_sha", "correlation_id").repartitionByRange(8, "batch_id").write.parquet(staged)
    store = SeenStore(spark, scratch(spark, "seen"), 16)
    stream = streams.read_table(spark, staged.rsplit("/", 1)[0], "pull_requests", spark.read.parquet(staged).schema, files=2)
    out = streams.run_to_end(stream, "queue", "append", hand_on=store.deliver)
    key = message_key(*[F.col(c) for c in ("correlation_id", "repo_name", "number", "head_sha", "msg_id")])
    return out.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("copies"))


_KEYED = f"""
WITH spelled AS (
  SELECT msg_id, received_at, lower(regexp_replace(correlation_id, '\\s', '', 'g')) AS plain,
         lower(regexp_replace(repo_name, '\\s', '', 'g')) AS repo, number, lower(regexp_replace(head_sha, '\\s', '', 'g')) AS sha
  FROM pull_requests),
digits AS (SELECT *, regexp_replace(regexp_replace(plain, '^urn:uuid:', ''), '[{{}}()-]', '', 'g') AS hex FROM spelled),
keyed AS (
  SELECT msg_id, received_at, CASE
    WHEN regexp_full_match(hex, '[0-9a-f]{{32}}') AND length(replace(hex, left(hex, 1), '')) > 0 THEN 'i:' || hex
    WHEN plain IS NOT NULL AND NOT regexp_full_match(hex, '[0-9a-f]{{32}}') AND plain NOT IN ({', '.join(f"'{s}'" for s in STAND_INS)}) THEN 'i:=' || plain
    WHEN sha IS NULL OR sha = '' THEN 'r:' || msg_id
    ELSE 'f:' || coalesce(repo, '~') || '|' || coalesce(number::VARCHAR, '~') || '|' || sha END AS key
  FROM digits),
ranked AS (SELECT msg_id, key, row_number() OVER (PARTITION BY key ORDER BY received_at NULLS LAST, msg_id) AS nth FROM keyed)
"""

QUERIES = {"p7_found": p7_found, "p7_delivered": p7_delivered, "p7_stream": p7_stream}
SQL = {
    "p7_found": _KEYED + "SELECT msg_id FROM ranked WHERE nth > 1",
    "p7_delivered": _KEYED + "SELECT msg_id FROM ranked WHERE nth = 1",
    "p7_stream": _KEYED + "SELECT key, 1::BIGINT AS copies FROM ranked GROUP BY key",
}
