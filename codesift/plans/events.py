"""Queries on events, deliveries and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesift.operators import events as ops
from codesift.operators.delivery import canonical_identifier
from codesift.sources.tables import table


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def deliveries_in_limit(spark: SparkSession, folder: str) -> DataFrame:
    """First deliveries within a day of each identifier."""
    messages = table(spark, folder, "pull_requests").withColumn("key", canonical_identifier(F.col("correlation_id")))
    return ops.within_limit(messages.select("msg_id", "key", "received_at"), "key", "received_at", "msg_id")


def retry_schedule(spark: SparkSession, folder: str) -> DataFrame:
    failed = _events(spark, folder).where("event_type = 'error'")
    return ops.attempt_schedule(failed.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id")


def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    dead = retry_schedule(spark, folder).where("dead")
    return dead.groupBy("user_id").agg(F.count(F.lit(1)).alias("letters"), F.max("attempt").alias("attempts"))


def _letters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "static_findings").select("static_id", "repo_name", F.concat_ws(": ", "rule_id", "message").alias("error"))


def dead_letter_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of fifty, latest first."""
    return ops.page(_letters(spark, folder).select("static_id"), [F.col("static_id").desc()], 50, 50)


def dead_letter_removed(spark: SparkSession, folder: str) -> DataFrame:
    return ops.without_index(_letters(spark, folder), [F.col("static_id").desc()], 10, "static_id")


def dead_letter_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = _letters(spark, folder).select(ops.error_class(F.col("error")).alias("error"), "repo_name")
    return rows.groupingSets([[F.col("error")], [F.col("repo_name")]], F.col("error"), F.col("repo_name")).agg(F.count(F.lit(1)).alias("letters"))


def latency_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "reviews").select(F.coalesce("llm_provider", F.lit("none")).alias("provider"), (F.col("duration_ms") / 1000).alias("seconds"))
    return ops.histogram(rows, ["provider"], "seconds")


def index_build_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "index_stats").select(F.coalesce("skipped_reason", F.lit("none")).alias("reason"), "duration_seconds")
    return ops.histogram(rows, ["reason"], "duration_seconds", (10, 30, 60, 120, 300, 600, 1800, 3600))


def latency_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder)
    return rows.groupBy("event_type").agg(F.round(F.expr("percentile(value, 0.5)"), 4).alias("p50"), F.round(F.expr("percentile(value, 0.95)"), 4).alias("p95"))


def reviews_in_flight(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "reviews").select(F.coalesce("llm_provider", F.lit("none")).alias("provider"), "started_at", "completed_at")
    return ops.in_flight(rows, ["provider"], "started_at", "completed_at")


def labelled_counters(spark: SparkSession, folder: str) -> DataFrame:
    """A long table of counters: metric, label, value."""
    reviews = table(spark, folder, "reviews").groupBy(F.col("status").alias("label")).agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("reviews"))
    findings = table(spark, folder, "findings").groupBy(F.col("agent").alias("label")).agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("findings"))
    events = table(spark, folder, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("events"))
    return reviews.unionByName(findings).unionByName(events)


def events_per_hour(spark: SparkSession, folder: str) -> DataFrame:
    return ops.per_window(_events(spark, folder), "ts", "1 hour", None, ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


def events_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return ops.per_window(_events(spark, folder), "ts", "6 hours", "2 hours", []).withColumn("start", F.col("start").cast("timestamp_ntz"))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    found = ops.sessions(_events(spark, folder), "ts", "30 minutes", "user_id")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


def latest_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The last run of each repository, and whether its index is fresh (a day) or stale at the time of the last run of all."""
    runs = table(spark, folder, "index_stats").where("started_at IS NOT NULL")
    last = ops.latest_per_key(runs, "repo_name", "run_id", "started_at", "run_id")
    times = runs.groupBy("repo_name").agg(F.max("started_at").alias("at"))
    now = runs.agg(F.max(F.unix_micros("started_at"))).first()[0] or 0
    age = (F.lit(now) - F.unix_micros("at")) / 3_600_000_000
    return last.join(times, "repo_name").select("repo_name", "run_id", F.round(age, 3).alias("age_hours"), F.when(age < 24, "fresh").otherwise("stale").alias("state"))


def expired_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories whose last run lies more than thirty days before the last run of all."""
    return latest_runs(spark, folder).where("age_hours > 720").select("repo_name")


def props_parsed(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("parsed"), F.count_if(F.col("k").isNull()).alias("bad"), F.sum("k").alias("total"))


def as_of_review(spark: SparkSession, folder: str) -> DataFrame:
    """For each review the message of its pull request last received before it was created: an as-of join by one sort."""
    reviews = table(spark, folder, "reviews").where("created_at IS NOT NULL").select("repo_name", F.col("pr_number").alias("number"), F.col("created_at").alias("at"), "review_id", F.lit(None).cast("bigint").alias("msg_id"), F.lit(1).alias("side"))
    messages = table(spark, folder, "pull_requests").select("repo_name", "number", F.col("received_at").alias("at"), F.lit(None).cast("string").alias("review_id"), "msg_id", F.lit(0).alias("side"))
    order = Window.partitionBy("repo_name", "number").orderBy("at", "side", "msg_id").rowsBetween(Window.unboundedPreceding, 0)
    both = reviews.unionByName(messages).withColumn("last", F.last("msg_id", True).over(order))
    return both.where("side = 1").select("review_id", F.col("last").alias("msg_id"))


_IDS = """ids AS (SELECT msg_id, received_at, CASE WHEN regexp_full_match(hex, '[0-9a-f]{32}') AND length(replace(hex, left(hex, 1), '')) > 0 THEN hex
  WHEN plain IS NOT NULL AND NOT regexp_full_match(hex, '[0-9a-f]{32}') AND plain NOT IN ('', '-', '--', '?', '0', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'undefined', 'unknown', 'missing', 'tbd', 'todo', 'default', 'empty', 'test') THEN '=' || plain END AS key
  FROM (SELECT *, regexp_replace(regexp_replace(plain, '^urn:uuid:', ''), '[{}()-]', '', 'g') AS hex FROM (SELECT msg_id, received_at, lower(regexp_replace(correlation_id, '\\s', '', 'g')) AS plain FROM pull_requests)))"""
_RETRY = "r AS (SELECT event_id, user_id, row_number() OVER w AS attempt, ts FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT event_id, user_id, attempt, CASE attempt WHEN 1 THEN 30 WHEN 2 THEN 60 WHEN 3 THEN 120 END AS wait_s FROM r)"


def _hist(bounds: tuple[float, ...]) -> str:
    return ", ".join(f"({float(b)}::DOUBLE)" for b in bounds) + ", (NULL)"


QUERIES = {
    q.__name__: q
    for q in (deliveries_in_limit, retry_schedule, dead_letters, dead_letter_page, dead_letter_removed, dead_letter_stats, latency_histogram, index_build_histogram, latency_quantiles, reviews_in_flight, labelled_counters, events_per_hour, events_sliding, event_sessions, latest_runs, expired_indexes, props_parsed, as_of_review)
}
SQL = {
    "deliveries_in_limit": "WITH RECURSIVE " + _IDS + """, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY received_at, msg_id) AS nth FROM ids WHERE key IS NOT NULL),
f AS (SELECT key, msg_id, nth, received_at AS opened, TRUE AS kept FROM o WHERE nth = 1 UNION ALL SELECT o.key, o.msg_id, o.nth, CASE WHEN epoch_us(o.received_at) - epoch_us(f.opened) >= 86400000000 THEN o.received_at ELSE f.opened END, epoch_us(o.received_at) - epoch_us(f.opened) >= 86400000000 FROM f JOIN o ON o.key = f.key AND o.nth = f.nth + 1)
SELECT msg_id FROM f WHERE kept UNION ALL SELECT msg_id FROM ids WHERE key IS NULL""",
    "retry_schedule": "WITH " + _RETRY + " SELECT event_id, user_id, attempt, wait_s, (sum(wait_s) OVER (PARTITION BY user_id ORDER BY attempt))::BIGINT AS total_s, wait_s IS NULL AS dead FROM s",
    "dead_letters": "WITH " + _RETRY + " SELECT user_id, count(*) AS letters, max(attempt) AS attempts FROM s WHERE wait_s IS NULL GROUP BY 1",
    "dead_letter_page": "SELECT static_id FROM static_findings ORDER BY static_id DESC LIMIT 50 OFFSET 50",
    "dead_letter_removed": "SELECT static_id, repo_name, concat_ws(': ', rule_id, message) AS error FROM static_findings WHERE static_id <> (SELECT static_id FROM static_findings ORDER BY static_id DESC LIMIT 1 OFFSET 10)",
    "dead_letter_stats": "SELECT error, repo_name, count(*) AS letters FROM (SELECT CASE WHEN e = '' THEN 'unknown' ELSE trim(string_split(e, ':')[1]) END AS error, repo_name FROM (SELECT concat_ws(': ', rule_id, message) AS e, repo_name FROM static_findings)) GROUP BY GROUPING SETS ((error), (repo_name))",
    "latency_histogram": f"WITH r AS (SELECT coalesce(llm_provider, 'none') AS provider, duration_ms / 1000 AS s FROM reviews), b(le) AS (VALUES {_hist(ops.BOUNDS)}) SELECT provider, le, count(*) FILTER (le IS NULL OR s <= le) AS count FROM r CROSS JOIN b WHERE s IS NOT NULL GROUP BY ALL",
    "index_build_histogram": f"WITH r AS (SELECT coalesce(skipped_reason, 'none') AS reason, duration_seconds AS s FROM index_stats), b(le) AS (VALUES {_hist((10, 30, 60, 120, 300, 600, 1800, 3600))}) SELECT reason, le, count(*) FILTER (le IS NULL OR s <= le) AS count FROM r CROSS JOIN b WHERE s IS NOT NULL GROUP BY ALL",
    "latency_quantiles": "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1",
    "reviews_in_flight": "WITH r AS (SELECT coalesce(llm_provider, 'none') AS provider, started_at, completed_at FROM reviews), m AS (SELECT provider, started_at AS t, 1 AS d FROM r WHERE started_at IS NOT NULL UNION ALL SELECT provider, completed_at, -1 FROM r WHERE completed_at IS NOT NULL), n AS (SELECT provider, t, d, sum(d) AS s FROM m GROUP BY ALL), o AS (SELECT provider, t, sum(s) OVER (PARTITION BY provider ORDER BY t, d) AS open FROM n) SELECT provider, max(open)::BIGINT AS most, min(t) FILTER (open = top) AS at FROM (SELECT *, max(open) OVER (PARTITION BY provider) AS top FROM o) GROUP BY provider",
    "labelled_counters": "SELECT 'reviews' AS metric, status AS label, count(*) AS value FROM reviews GROUP BY ALL UNION ALL SELECT 'findings', agent, count(*) FROM findings GROUP BY ALL UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY ALL",
    "events_per_hour": "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "events_sliding": "SELECT time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01') - i * INTERVAL '2 hours' AS start, count(*) AS events, round(sum(value), 2) AS total FROM events, range(3) t(i) GROUP BY 1",
    "event_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS events FROM s GROUP BY user_id, n",
    "latest_runs": "WITH l AS (SELECT repo_name, arg_max(run_id, (started_at, run_id)) AS run_id, max(started_at) AS seen FROM index_stats WHERE started_at IS NOT NULL GROUP BY 1), n AS (SELECT max(started_at) AS now FROM index_stats) SELECT repo_name, run_id, round((epoch_us(now) - epoch_us(seen)) / 3600000000, 3) AS age_hours, CASE WHEN (epoch_us(now) - epoch_us(seen)) / 3600000000 < 24 THEN 'fresh' ELSE 'stale' END AS state FROM l CROSS JOIN n",
    "expired_indexes": "SELECT repo_name FROM index_stats WHERE started_at IS NOT NULL GROUP BY 1 HAVING round((epoch_us((SELECT max(started_at) FROM index_stats)) - epoch_us(max(started_at))) / 3600000000, 3) > 720",
    "props_parsed": "SELECT event_type, count(k) AS parsed, count(*) FILTER (k IS NULL) AS bad, sum(k)::BIGINT AS total FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    "as_of_review": "SELECT review_id, (SELECT arg_max(msg_id, (received_at, msg_id)) FROM pull_requests p WHERE p.repo_name = r.repo_name AND p.number = r.pr_number AND p.received_at <= r.created_at) AS msg_id FROM reviews r WHERE created_at IS NOT NULL",
}
