"""Queries on reviews and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesift.operators import reviews
from codesift.operators.reviews import AGENTS, SEVERITIES
from codesift.sources.tables import table


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "findings")


def _named(spark: SparkSession, folder: str) -> DataFrame:
    return _findings(spark, folder).withColumn("severity_name", reviews.severity_name(F.col("severity")))


def findings_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """Per review and agent, one finding a line, and all without a line."""
    return reviews.deduplicated(_findings(spark, folder), ["review_id", "agent", "file_path"], [F.col("finding_id")])


def findings_distinct_texts(spark: SparkSession, folder: str) -> DataFrame:
    placed = _findings(spark, folder).where("line_number >= 1")
    return reviews.one_description_each(placed, ["review_id", "agent", "file_path", "line_number"], [F.col("finding_id")]).select("finding_id")


def inline_most_severe(spark: SparkSession, folder: str) -> DataFrame:
    """Across agents, the finding shown on each line."""
    order = [reviews.rank_of(F.col("agent"), AGENTS), F.col("finding_id")]
    return reviews.most_severe_per_line(_findings(spark, folder), ["review_id", "file_path"], order)


def inline_comments(spark: SparkSession, folder: str) -> DataFrame:
    chosen = inline_most_severe(spark, folder).select("finding_id")
    return reviews.inline_body(_findings(spark, folder).join(chosen, "finding_id"))


def severity_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.severity_counts(_named(spark, folder).where("review_id IS NOT NULL"), ["review_id"])


def findings_by_severity(spark: SparkSession, folder: str) -> DataFrame:
    joined = _named(spark, folder).join(table(spark, folder, "reviews").select("review_id", "repo_name"), "review_id")
    return joined.groupBy("repo_name", F.col("severity_name").alias("severity")).agg(F.count(F.lit(1)).alias("findings"))


def review_stats(spark: SparkSession, folder: str) -> DataFrame:
    done = F.when(F.col("status") == "completed", F.col("duration_ms"))
    stats = table(spark, folder, "reviews").groupBy("repo_name").agg(F.count(F.lit(1)).alias("reviews"), F.avg(done).alias("d"), F.avg("findings_count").alias("f"))
    return stats.select("repo_name", "reviews", F.coalesce(F.round("d", 1), F.lit(0.0)).alias("avg_duration_ms"), F.coalesce(F.round("f", 1), F.lit(0.0)).alias("avg_findings"))


def recent_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """The latest twenty reviews of each repository."""
    latest = Window.partitionBy("repo_name").orderBy(F.col("created_at").desc_nulls_last(), "review_id")
    rows = table(spark, folder, "reviews").select("review_id", "repo_name", "created_at").withColumn("place", F.row_number().over(latest))
    return rows.where("place <= 20").select("repo_name", "review_id", F.col("place").cast("bigint").alias("place"))


def findings_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each finding in its review, most severe first."""
    order = Window.partitionBy("review_id").orderBy(reviews.rank_of(F.col("severity_name"), SEVERITIES), "finding_id")
    return _named(spark, folder).where("review_id IS NOT NULL").select("review_id", "finding_id", F.row_number().over(order).cast("bigint").alias("place"))


def findings_count_check(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews whose stated number of findings is not that of the rows."""
    counted = _findings(spark, folder).groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, folder, "reviews").select("review_id", "findings_count").join(counted, "review_id", "left").withColumn("rows", F.coalesce("n", F.lit(0)))
    return joined.where(~F.col("findings_count").eqNullSafe(F.col("rows").cast("int"))).select("review_id", "findings_count", "rows")


def findings_invalid(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.violations(_findings(spark, folder))


def agent_reports(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.merged_reports(_findings(spark, folder).where("review_id IS NOT NULL"), "review_id")


def decision_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by agent, by category and in all, with the number of low confidence and the mean of usable ones."""
    usable = F.when((F.col("confidence") >= 0) & (F.col("confidence") <= 1), F.col("confidence"))
    rows = _findings(spark, folder).select("agent", F.lower(F.trim("category")).alias("category"), usable.alias("confidence"))
    grouped = rows.groupingSets([[F.col("agent")], [F.col("category")], []], F.col("agent"), F.col("category"))
    return grouped.agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("confidence") < 0.7).alias("low"), F.round(F.avg("confidence"), 4).alias("mean"))


def decision_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds from each finding of a review to the one before."""
    order = Window.partitionBy("review_id").orderBy("created_at", "finding_id")
    rows = _findings(spark, folder).where("review_id IS NOT NULL AND created_at IS NOT NULL")
    at = F.unix_micros("created_at")
    return rows.select("review_id", "finding_id", F.row_number().over(order).cast("bigint").alias("step"), (at - F.lag(at).over(order)).alias("wait_us"))


def repo_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Findings rolled up over owner, repository and severity."""
    joined = _named(spark, folder).join(table(spark, folder, "reviews").select("review_id", "repo_name"), "review_id")
    rows = joined.select(F.split("repo_name", "/")[0].alias("owner"), "repo_name", F.col("severity_name").alias("severity"))
    return rows.rollup("owner", "repo_name", "severity").agg(F.count(F.lit(1)).alias("findings"), F.grouping_id().alias("level"))


def provider_cube(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "reviews").select(F.coalesce("llm_provider", F.lit("none")).alias("provider"), "status", "files_changed")
    return rows.cube("provider", "status").agg(F.count(F.lit(1)).alias("reviews"), F.sum("files_changed").alias("files"))


def org_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and their value by region and nation of the customer."""
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    places = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    joined = orders.join(customers, "c_custkey").join(places, "n_nationkey")
    return joined.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))


_NAMED = "named AS (SELECT *, CASE WHEN upper(trim(severity)) IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO') THEN upper(trim(severity)) ELSE 'INFO' END AS sev FROM findings),\nranked AS (SELECT *, CASE sev WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END AS rank, CASE agent WHEN 'security' THEN 1 WHEN 'quality' THEN 2 WHEN 'performance' THEN 3 WHEN 'observability' THEN 4 ELSE 99 END AS turn FROM named)"
_INLINE = "inl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id, file_path, line_number ORDER BY rank, turn, finding_id) AS nth FROM ranked WHERE line_number >= 1) WHERE nth = 1)"

QUERIES = {
    q.__name__: q
    for q in (findings_deduplicated, findings_distinct_texts, inline_most_severe, inline_comments, severity_counts, findings_by_severity, review_stats, recent_reviews, findings_listing, findings_count_check, findings_invalid, agent_reports, decision_summary, decision_timeline, repo_rollup, provider_cube, org_rollup)
}
SQL = {
    "findings_deduplicated": f"WITH {_NAMED} SELECT finding_id FROM ranked WHERE line_number IS NULL OR line_number < 1 UNION ALL SELECT finding_id FROM (SELECT finding_id, row_number() OVER (PARTITION BY review_id, agent, file_path, line_number ORDER BY rank, finding_id) AS nth FROM ranked WHERE line_number >= 1) WHERE nth = 1",
    "findings_distinct_texts": "SELECT min(finding_id) AS finding_id FROM findings WHERE line_number >= 1 GROUP BY review_id, agent, file_path, line_number, lower(trim(coalesce(description, '')))",
    "inline_most_severe": f"WITH {_NAMED}, {_INLINE} SELECT review_id, file_path, line_number, finding_id FROM inl",
    "inline_comments": f"WITH {_NAMED}, {_INLINE} SELECT finding_id, file_path AS path, line_number AS line, '**' || sev || '** — ' || coalesce(category, '') || chr(10) || chr(10) || coalesce(description, '') || CASE WHEN length(current_code) > 0 THEN chr(10) || chr(10) || '**Current code:**' || chr(10) || '```' || chr(10) || current_code || chr(10) || '```' ELSE '' END AS body, CASE WHEN length(suggested_fix) > 0 THEN suggested_fix END AS suggestion FROM inl",
    "severity_counts": f"WITH {_NAMED}, r AS (SELECT DISTINCT review_id FROM findings WHERE review_id IS NOT NULL), s AS (SELECT unnest(['CRITICAL','HIGH','MEDIUM','LOW','INFO']) AS severity) SELECT r.review_id, s.severity, count(n.finding_id) AS n FROM r CROSS JOIN s LEFT JOIN named n ON n.review_id = r.review_id AND n.sev = s.severity GROUP BY ALL",
    "findings_by_severity": f"WITH {_NAMED} SELECT repo_name, sev AS severity, count(*) AS findings FROM named JOIN reviews USING (review_id) GROUP BY ALL",
    "review_stats": "SELECT repo_name, count(*) AS reviews, coalesce(round(avg(CASE WHEN status = 'completed' THEN duration_ms END), 1), 0.0) AS avg_duration_ms, coalesce(round(avg(findings_count), 1), 0.0) AS avg_findings FROM reviews GROUP BY 1",
    "recent_reviews": "SELECT repo_name, review_id, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY created_at DESC NULLS LAST, review_id) AS place FROM reviews) WHERE place <= 20",
    "findings_listing": f"WITH {_NAMED} SELECT review_id, finding_id, row_number() OVER (PARTITION BY review_id ORDER BY rank, finding_id) AS place FROM ranked WHERE review_id IS NOT NULL",
    "findings_count_check": "WITH c AS (SELECT review_id, count(*) AS n FROM findings GROUP BY 1) SELECT review_id, findings_count, coalesce(n, 0) AS rows FROM reviews LEFT JOIN c USING (review_id) WHERE findings_count IS DISTINCT FROM coalesce(n, 0)",
    "findings_invalid": "SELECT finding_id, errors FROM (SELECT finding_id, list_filter([CASE WHEN line_number < 1 THEN 'line_number' END, CASE WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'confidence' END, CASE WHEN length(coalesce(description, '')) < 10 THEN 'description' END, CASE WHEN severity IS NULL OR severity NOT IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO') THEN 'severity' END, CASE WHEN review_id IS NULL THEN 'review_id' END], lambda e: e IS NOT NULL) AS errors FROM findings) WHERE len(errors) > 0",
    "agent_reports": "SELECT review_id, agent, count(*) AS findings, string_agg(coalesce(description, ''), ' | ' ORDER BY finding_id) AS summary, list(line_number ORDER BY finding_id) AS lines FROM findings WHERE review_id IS NOT NULL GROUP BY ALL",
    "decision_summary": "SELECT agent, category, count(*) AS findings, count(*) FILTER (confidence < 0.7) AS low, round(avg(confidence), 4) AS mean FROM (SELECT agent, lower(trim(category)) AS category, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS confidence FROM findings) GROUP BY GROUPING SETS ((agent), (category), ())",
    "decision_timeline": "SELECT review_id, finding_id, row_number() OVER w AS step, epoch_us(created_at) - lag(epoch_us(created_at)) OVER w AS wait_us FROM findings WHERE review_id IS NOT NULL AND created_at IS NOT NULL WINDOW w AS (PARTITION BY review_id ORDER BY created_at, finding_id)",
    "repo_rollup": f"WITH {_NAMED}, x AS (SELECT string_split(repo_name, '/')[1] AS owner, repo_name, sev AS severity FROM named JOIN reviews USING (review_id)) SELECT owner, repo_name, severity, count(*) AS findings, grouping(owner, repo_name, severity)::BIGINT AS level FROM x GROUP BY ROLLUP (owner, repo_name, severity)",
    "provider_cube": "SELECT provider, status, count(*) AS reviews, sum(files_changed)::BIGINT AS files FROM (SELECT coalesce(llm_provider, 'none') AS provider, status, files_changed FROM reviews) GROUP BY CUBE (provider, status)",
    "org_rollup": "SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
}
