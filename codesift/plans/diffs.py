"""Queries on unified diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.operators import diffs
from codesift.sources.tables import table


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return diffs.diff_lines(table(spark, folder, "pull_requests"), "msg_id")


def diff_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder)


def diff_valid_lines(spark: SparkSession, folder: str) -> DataFrame:
    return diffs.valid_lines(_lines(spark, folder), "msg_id")


def diff_hunks(spark: SparkSession, folder: str) -> DataFrame:
    return diffs.islands(diffs.valid_lines(_lines(spark, folder), "msg_id"), ["msg_id", "file_path"], "new_line")


def diff_context_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return diffs.widen(diff_hunks(spark, folder), ["msg_id", "file_path"], 30)


def diff_annotated(spark: SparkSession, folder: str) -> DataFrame:
    return diffs.annotated(_lines(spark, folder), "msg_id")


def diff_by_file(spark: SparkSession, folder: str) -> DataFrame:
    return diffs.split_by_file(table(spark, folder, "pull_requests"), "msg_id")


def diff_added_source(spark: SparkSession, folder: str) -> DataFrame:
    """The added lines of each file as one text, with their real line numbers."""
    added = _lines(spark, folder).where("kind = '+'")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "new_line", "content")))
    folded = added.groupBy("msg_id", "file_path").agg(ordered.alias("o"))
    return folded.select("msg_id", "file_path", F.transform("o", lambda x: x["new_line"]).alias("line_numbers"), F.array_join(F.transform("o", lambda x: x["content"]), "\n").alias("source"))


def diff_files_fitting(spark: SparkSession, folder: str) -> DataFrame:
    """The files of each message kept under a total of 600 characters."""
    parts = diff_by_file(spark, folder).withColumn("size", F.length("patch"))
    return diffs.fitting(parts, "msg_id", "file_path", "size", 600)


def changed_files_without_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Files that a message names as changed and its diff does not hold."""
    named = table(spark, folder, "pull_requests").where("diff IS NOT NULL").select("msg_id", F.explode("changed_files").alias("file_path")).distinct()
    return named.join(_lines(spark, folder).select("msg_id", "file_path").distinct(), ["msg_id", "file_path"], "left_anti")


def _comments(spark: SparkSession, folder: str) -> DataFrame:
    findings = table(spark, folder, "findings").select("finding_id", "review_id", "file_path", "line_number")
    reviews = table(spark, folder, "reviews").select("review_id", "repo_name", "pr_number")
    return findings.join(reviews, "review_id")


def _valid(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "pull_requests").select("msg_id", "repo_name", F.col("number").alias("pr_number"))
    return diff_valid_lines(spark, folder).join(names, "msg_id")


def comments_on_diff(spark: SparkSession, folder: str) -> DataFrame:
    return diffs.on_valid_lines(_comments(spark, folder), _valid(spark, folder)).select("finding_id")


def comments_off_diff(spark: SparkSession, folder: str) -> DataFrame:
    return diffs.on_valid_lines(_comments(spark, folder), _valid(spark, folder), keep=False).select("finding_id")


_LINES = """
WITH raw AS (SELECT msg_id, unnest(string_split(diff, chr(10))) AS raw, generate_subscripts(string_split(diff, chr(10)), 1) - 1 AS seq FROM pull_requests WHERE diff IS NOT NULL),
s AS (SELECT *, count(CASE WHEN starts_with(raw, 'diff --git ') THEN 1 END) OVER (PARTITION BY msg_id ORDER BY seq) AS section, try_cast(regexp_extract(raw, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@', 1) AS INT) AS start FROM raw),
h AS (SELECT *, count(start) OVER (PARTITION BY msg_id, section ORDER BY seq) AS hunk FROM s),
f AS (SELECT *, last_value(CASE WHEN hunk = 0 AND starts_with(raw, '+++ ') THEN regexp_extract(raw, '^\\+\\+\\+ (?:b/)?(.+)$', 1) END IGNORE NULLS) OVER (PARTITION BY msg_id, section ORDER BY seq) AS file_path,
  CASE WHEN start IS NOT NULL OR hunk = 0 THEN NULL WHEN raw[1] = '+' THEN '+' WHEN raw[1] = '-' THEN '-' WHEN raw[1] = ' ' THEN 'context' END AS kind FROM h),
n AS (SELECT *, CASE WHEN kind IN ('+', 'context') THEN (max(start) OVER (PARTITION BY msg_id, section, hunk) + count(CASE WHEN kind IN ('+', 'context') THEN 1 END) OVER (PARTITION BY msg_id, section, hunk ORDER BY seq) - 1)::INT END AS new_line FROM f WHERE file_path IS NOT NULL AND file_path <> '/dev/null'),
lines AS (SELECT msg_id, seq::INT AS seq, file_path, kind, new_line, substr(raw, 2) AS content FROM n WHERE kind IS NOT NULL),
valid AS (SELECT msg_id, file_path, new_line, bool_or(kind = '+') AS added FROM lines WHERE new_line IS NOT NULL GROUP BY ALL),
hunks AS (SELECT msg_id, file_path, min(new_line) AS first, max(new_line) AS last FROM (SELECT *, new_line - row_number() OVER (PARTITION BY msg_id, file_path ORDER BY new_line) AS run FROM valid) GROUP BY msg_id, file_path, run),
sections AS (SELECT msg_id, min(CASE WHEN starts_with(raw, '+++ ') THEN seq END) AS at, section, string_agg(raw, chr(10) ORDER BY seq) AS patch FROM s GROUP BY msg_id, section),
files AS (SELECT x.msg_id, regexp_extract(s.raw, '^\\+\\+\\+ (?:b/)?(.+)$', 1) AS file_path, patch FROM sections x JOIN s ON s.msg_id = x.msg_id AND s.seq = x.at),
comments AS (SELECT finding_id, repo_name, pr_number, file_path, line_number FROM findings JOIN reviews USING (review_id)),
places AS (SELECT DISTINCT p.repo_name, p.number AS pr_number, v.file_path, v.new_line AS line_number FROM valid v JOIN pull_requests p USING (msg_id))
"""
QUERIES = {q.__name__: q for q in (diff_lines, diff_valid_lines, diff_hunks, diff_context_ranges, diff_annotated, diff_by_file, diff_added_source, diff_files_fitting, changed_files_without_diff, comments_on_diff, comments_off_diff)}
SQL = {
    "diff_lines": _LINES + "SELECT * FROM lines",
    "diff_valid_lines": _LINES + "SELECT * FROM valid",
    "diff_hunks": _LINES + "SELECT * FROM hunks",
    "diff_context_ranges": _LINES + """, w AS (SELECT msg_id, file_path, greatest(1, first - 30) AS first, last + 30 AS last FROM hunks),
m AS (SELECT *, max(last) OVER (PARTITION BY msg_id, file_path ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR first > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY msg_id, file_path ORDER BY first, last) AS run FROM m)
SELECT msg_id, file_path, min(first)::INT AS first, max(last)::INT AS last FROM r GROUP BY msg_id, file_path, run""",
    "diff_annotated": _LINES + "SELECT msg_id, file_path, string_agg(CASE kind WHEN '-' THEN '       [-] ' || content WHEN '+' THEN '  L' || lpad(new_line::VARCHAR, 4, ' ') || ' [+] ' || content ELSE '  L' || lpad(new_line::VARCHAR, 4, ' ') || '     ' || content END, chr(10) ORDER BY seq) AS annotated FROM lines GROUP BY ALL",
    "diff_by_file": _LINES + "SELECT * FROM files WHERE file_path <> ''",
    "diff_added_source": _LINES + "SELECT msg_id, file_path, list(new_line ORDER BY seq) AS line_numbers, string_agg(content, chr(10) ORDER BY seq) AS source FROM lines WHERE kind = '+' GROUP BY ALL",
    "diff_files_fitting": _LINES.replace("WITH raw", "WITH RECURSIVE raw") + """, o AS (SELECT msg_id, file_path, length(patch) AS size, row_number() OVER (PARTITION BY msg_id ORDER BY file_path, length(patch)) AS nth FROM files WHERE file_path <> ''),
fold AS (SELECT msg_id, 0::BIGINT AS nth, 0::BIGINT AS total, NULL::VARCHAR AS file_path, FALSE AS kept FROM (SELECT DISTINCT msg_id FROM o)
  UNION ALL SELECT o.msg_id, o.nth, CASE WHEN fold.total + o.size > 600 THEN fold.total ELSE fold.total + o.size END, o.file_path, fold.total + o.size <= 600 FROM fold JOIN o ON o.msg_id = fold.msg_id AND o.nth = fold.nth + 1)
SELECT msg_id, file_path FROM fold WHERE kept""",
    "changed_files_without_diff": _LINES + "SELECT DISTINCT msg_id, file_path FROM (SELECT msg_id, unnest(changed_files) AS file_path FROM pull_requests WHERE diff IS NOT NULL) c WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.msg_id = c.msg_id AND l.file_path = c.file_path)",
    "comments_on_diff": _LINES + "SELECT finding_id FROM comments SEMI JOIN places USING (repo_name, pr_number, file_path, line_number)",
    "comments_off_diff": _LINES + "SELECT finding_id FROM comments ANTI JOIN places USING (repo_name, pr_number, file_path, line_number)",
}
