"""Sinks: batches of streams, audit records published as one, reviews posted by the first way that works, and the tables themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Tables of the index and of the audit, and the column by which the index is cut.
COLLECTIONS = {
    "repo_chunks": ("repo_name STRING, file_path STRING, chunk_index INT, chunk_type STRING, symbol_name STRING, start_line INT, end_line INT, symbols_defined ARRAY<STRING>, symbols_called ARRAY<STRING>, imports ARRAY<STRING>, content STRING, content_hash STRING, embedding ARRAY<FLOAT>, indexed_at TIMESTAMP", "repo_name"),
    "code_graphs": ("repo_name STRING, file_path STRING, functions ARRAY<STRING>, classes ARRAY<STRING>, imports ARRAY<STRING>, node_count BIGINT, pr_number INT", "repo_name"),
    "import_files": ("repo_name STRING, file_path STRING, source_code STRING, pr_number INT", "repo_name"),
    "learnings": ("commit_message STRING, bot_comment STRING, user_feedback STRING", None),
}
AUDIT = {
    "reviews": "review_id STRING, repo_name STRING, pr_number INT, pr_title STRING, status STRING, files_changed INT, findings_count INT, duration_ms INT, llm_provider STRING, llm_model STRING, created_at TIMESTAMP, completed_at TIMESTAMP",
    "decisions": "review_id STRING, agent_role STRING, decision_type STRING, description STRING, rationale STRING, confidence DOUBLE, created_at TIMESTAMP",
    "findings": "review_id STRING, agent_role STRING, severity STRING, file_path STRING, line_number INT, title STRING, description STRING, suggestion STRING, created_at TIMESTAMP",
}


def create_tables(spark: SparkSession, database: str) -> list[str]:
    """The tables of the index and of the audit, where they are missing; their names."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    made = []
    for name, (columns, by) in COLLECTIONS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet" + (f" PARTITIONED BY ({by})" if by else ""))
        made.append(name)
    for name, columns in AUDIT.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.audit_{name} ({columns}) USING parquet")
        made.append(f"audit_{name}")
    return made


def batches_into(folder: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: each batch has a folder of its own, so one that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return write


def publish_together(tables: dict[str, DataFrame], folder: str, run: str) -> bool:
    """Write the tables of a run and make them visible by one rename; False if the run is there already.

    A reader of ``folder``/run=*/``name`` sees all tables of a run or none.
    What a run that died left behind is written over.
    """
    spark = next(iter(tables.values())).sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    pending, final = path(f"{folder}/_pending-{run}"), path(f"{folder}/run={run}")
    system = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(final):
        return False
    system.delete(pending, True)
    for name, rows in tables.items():
        rows.write.parquet(f"{pending.toString()}/{name}")
    if not system.rename(pending, final):
        raise OSError(f"cannot publish {run}")
    return True


def post(reviews: DataFrame, ways: list[tuple[str, Callable[[str, str, list[str]], None]]]) -> DataFrame:
    """(review_id, posted_by, failures): each review by the first of ``ways`` that does not fail; null if none works.

    ``reviews`` has review_id, summary and comments (an array).  A way is a
    name and a function of these three.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for review, summary, comments in zip(batch["review_id"], batch["summary"], batch["comments"], strict=True):
                failures, by = [], None
                for name, way in ways:
                    try:
                        way(review, summary, [] if comments is None else list(comments))
                        by = name
                        break
                    except Exception as failure:  # noqa: BLE001 - whatever the caller's way raises
                        failures.append(f"{name}: {failure}")
                out.append((review, by, failures))
            yield pd.DataFrame(out, columns=["review_id", "posted_by", "failures"])

    return reviews.select("review_id", "summary", "comments").mapInPandas(run, "review_id STRING, posted_by STRING, failures ARRAY<STRING>")
