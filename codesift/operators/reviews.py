"""Findings and reviews: selection per line, counts, merged reports, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Severities from most to least severe, and agents in the order in which their reports are read.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
AGENTS = ("security", "quality", "performance", "observability")


def severity_name(column: Column) -> Column:
    """One of the five names; what is none counts as INFO."""
    name = F.upper(F.trim(column))
    return F.when(name.isin(*SEVERITIES), name).otherwise("INFO")


def rank_of(column: Column, order: tuple[str, ...]) -> Column:
    ranks = F.create_map(*[x for i, name in enumerate(order) for x in (F.lit(name), F.lit(i + 1))])
    return F.coalesce(ranks[column], F.lit(99))


def one_description_each(findings: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of findings of one place with equal descriptions, apart from case and blanks at the ends, the first."""
    text = F.lower(F.trim(F.coalesce("description", F.lit(""))))
    first = F.row_number().over(Window.partitionBy(*keys, text).orderBy(*order))
    return findings.withColumn("nth", first).where("nth = 1").drop("nth")


def most_severe_per_line(findings: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The most severe finding of each place; ties go to the first in ``order``.  Rows without a line of at least 1 are left out.

    ``min_by`` combines before the shuffle, so a line of very many findings is
    no hot group; the description filter cannot change which one is chosen,
    since it keeps the first of equals.
    """
    placed = findings.where("line_number >= 1")
    best = F.min(F.struct(rank_of(severity_name(F.col("severity")), SEVERITIES).alias("rank"), *[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("finding_id")))
    return placed.groupBy(*keys, "line_number").agg(best["finding_id"].alias("finding_id"))


def deduplicated(findings: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Findings without a line as they are, and one finding per line."""
    general = findings.where("line_number IS NULL OR line_number < 1").select("finding_id")
    return general.unionByName(most_severe_per_line(findings, keys, order).select("finding_id"))


def severity_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and severity, zeros included."""
    counted = findings.groupBy(*keys).pivot("severity_name", list(SEVERITIES)).agg(F.count(F.lit(1)))
    stacked = F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.coalesce(F.col(s), F.lit(0)).alias("n")) for s in SEVERITIES]))
    return counted.select(*keys, stacked.alias("x")).select(*keys, "x.severity", "x.n")


def merged_reports(findings: DataFrame, key: str) -> DataFrame:
    """Per review and agent: number of findings, the texts joined in order, the lines as an array."""
    ordered = F.array_sort(F.collect_list(F.struct("finding_id", F.coalesce("description", F.lit("")).alias("description"), F.col("line_number"))))
    folded = findings.groupBy(key, "agent").agg(ordered.alias("o"))
    return folded.select(key, "agent", F.size("o").cast("bigint").alias("findings"), F.array_join(F.transform("o", lambda x: x["description"]), " | ").alias("summary"), F.transform("o", lambda x: x["line_number"]).alias("lines"))


def violations(findings: DataFrame) -> DataFrame:
    """(finding_id, errors): the rules of a finding's schema that a row breaks."""
    checks = [
        (F.col("line_number").isNotNull() & (F.col("line_number") < 1), "line_number"),
        (F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence"),
        (F.length(F.coalesce("description", F.lit(""))) < 10, "description"),
        (~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "severity"),
        (F.col("review_id").isNull(), "review_id"),
    ]
    errors = F.filter(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]), lambda e: e.isNotNull())
    return findings.select("finding_id", errors.alias("errors")).where(F.size("errors") > 0)


def inline_body(findings: DataFrame) -> DataFrame:
    """(finding_id, path, line, body, suggestion): what a comment on a line shows."""
    code = F.when(F.length("current_code") > 0, F.concat(F.lit("\n\n**Current code:**\n```\n"), "current_code", F.lit("\n```"))).otherwise("")
    body = F.concat(F.lit("**"), severity_name(F.col("severity")), F.lit("** — "), F.coalesce("category", F.lit("")), F.lit("\n\n"), F.coalesce("description", F.lit("")), code)
    return findings.select("finding_id", F.col("file_path").alias("path"), F.col("line_number").alias("line"), body.alias("body"), F.when(F.length("suggested_fix") > 0, F.col("suggested_fix")).alias("suggestion"))
