"""Task graphs: readiness, levels, failure, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.runtime import cut_lineage

# States in which a task is done with.
TERMINAL = ("completed", "failed", "skipped")


def ready(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of pending tasks of which all dependencies are done with; ``edges`` go from dependency to task."""
    states = tasks.select(F.col("id").alias("src"), F.col("status").isin(*TERMINAL).alias("done"))
    waits = edges.join(states, "src", "left").groupBy(F.col("dst").alias("id")).agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("free"))
    return tasks.where("status = 'pending'").join(waits, "id", "left").where(F.coalesce("free", F.lit(True))).select("id")


def levels(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): the longest path from a root; tasks on a cycle or behind one have null.

    A round takes the tasks whose dependencies all have a level; there are as
    many rounds as the graph is deep.
    """
    left, found, depth = tasks.select("id"), None, 0
    while True:
        # whatever no remaining task leads to comes next
        blocked = edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        now = cut_lineage(left.join(blocked, "id", "left_anti"))
        if now.isEmpty():
            rest = left.withColumn("level", F.lit(None).cast("int"))
            return rest if found is None else found.unionByName(rest)
        level = now.withColumn("level", F.lit(depth))
        found = level if found is None else found.unionByName(level)
        left = cut_lineage(left.join(now, "id", "left_anti"))
        depth += 1


def on_cycles(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of tasks that can never start because of a cycle."""
    return levels(tasks, edges).where("level IS NULL").select("id")


def unknown_dependencies(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(tasks.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst")


def skipped_by_failure(tasks: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(id) of pending tasks that a failed task leads to within ``rounds`` edges; aggregators run all the same."""
    plain = tasks.where("role <> 'aggregator'").select("id", "status")
    reached = tasks.where("status IN ('failed', 'skipped')").select("id")
    for _ in range(rounds):
        step = edges.join(reached.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        more = cut_lineage(reached.union(step.join(plain.where("status = 'pending'"), "id", "left_semi")).distinct())
        if more.count() == reached.count():
            break
        reached = more
    return plain.where("status = 'pending'").join(reached, "id", "left_semi").select("id")


def progress(tasks: DataFrame) -> DataFrame:
    """Tasks per state and the share that is done with, in percent."""
    done = F.count_if(F.col("status").isin(*TERMINAL))
    return tasks.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(100 * done / F.count(F.lit(1)), 1).alias("percent"))
