"""Unified diffs as a relation of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILE_MARK = r"^\+\+\+ (?:b/)?(.+)$"
HUNK_MARK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def raw_lines(messages: DataFrame, key: str, text: str = "diff") -> DataFrame:
    """(key, seq, raw) of every line of every diff."""
    return messages.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("seq", "raw"))


def diff_lines(messages: DataFrame, key: str, text: str = "diff") -> DataFrame:
    """(key, seq, file_path, kind, new_line, content).

    ``kind`` is +, - or context; deleted lines have no ``new_line``.  A header
    counts as one only outside a hunk's lines, so an added line that begins
    with ``++ b/`` stays an added line; a deleted file's ``/dev/null`` opens no
    file.  The file is carried forward and the line number is the hunk's start
    plus the lines of the new side before: two windows on one sort.
    """
    lines = raw_lines(messages, key, text)
    order = Window.partitionBy(key).orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    header = F.col("raw").startswith("diff --git ")
    hunk = F.regexp_extract("raw", HUNK_MARK, 1)
    # before the first hunk of a file lie its headers
    lines = lines.withColumn("section", F.count(F.when(header, 1)).over(so_far)).withColumn("start", F.when(hunk != "", hunk.cast("int")))
    part = Window.partitionBy(key, "section").orderBy("seq")
    to_here = part.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("hunk", F.count("start").over(to_here))
    name = F.when((F.col("hunk") == 0) & F.col("raw").startswith("+++ "), F.regexp_extract("raw", FILE_MARK, 1))
    lines = lines.withColumn("file_path", F.last(name, True).over(to_here)).where(F.col("file_path").isNotNull() & (F.col("file_path") != "/dev/null"))
    first = F.substring("raw", 1, 1)
    kind = F.when(F.col("start").isNotNull() | (F.col("hunk") == 0), None).when(first == "+", "+").when(first == "-", "-").when(first == " ", "context")
    lines = lines.withColumn("kind", kind)
    inside = Window.partitionBy(key, "section", "hunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.count(F.when(F.col("kind").isin("+", "context"), 1)).over(inside)
    begin = F.max("start").over(Window.partitionBy(key, "section", "hunk"))
    numbered = lines.withColumn("new_line", F.when(F.col("kind").isin("+", "context"), (begin + before).cast("int")))
    return numbered.where("kind IS NOT NULL").select(key, "seq", "file_path", "kind", "new_line", F.expr("substring(raw, 2)").alias("content"))


def valid_lines(lines: DataFrame, key: str) -> DataFrame:
    """(key, file_path, new_line, added): the lines of the new side."""
    return lines.where("new_line IS NOT NULL").groupBy(key, "file_path", "new_line").agg(F.max(F.col("kind") == "+").alias("added"))


def islands(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, first, last): runs of consecutive values; gaps and islands."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(value))
    runs = rows.select(*group, value).distinct().withColumn("run", F.col(value) - place)
    return runs.groupBy(*group, "run").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("run")


def widen(ranges: DataFrame, group: list[str], around: int, end: Column | None = None) -> DataFrame:
    """Ranges widened by ``around`` lines on both sides, clamped to 1 and ``end``, and merged where they touch."""
    last = F.col("last") + around
    wide = ranges.select(*group, F.greatest(F.lit(1), F.col("first") - around).alias("first"), (last if end is None else F.least(last, end)).alias("last"))
    order = Window.partitionBy(*group).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0)
    marked = wide.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    return marked.groupBy(*group, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def annotated(lines: DataFrame, key: str) -> DataFrame:
    """(key, file_path, annotated): a file's diff with the line numbers of the new side."""
    mark = F.when(F.col("kind") == "-", F.concat(F.lit("       [-] "), "content")).when(F.col("kind") == "+", F.concat(F.lit("  L"), F.lpad(F.col("new_line").cast("string"), 4, " "), F.lit(" [+] "), "content")).otherwise(F.concat(F.lit("  L"), F.lpad(F.col("new_line").cast("string"), 4, " "), F.lit("     "), "content"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", mark.alias("line"))))
    return lines.groupBy(key, "file_path").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("annotated"))


def split_by_file(messages: DataFrame, key: str, text: str = "diff") -> DataFrame:
    """(key, file_path, section): each file's part of a diff, headers included."""
    lines = raw_lines(messages, key, text)
    lines = lines.withColumn("section", F.count(F.when(F.col("raw").startswith("diff --git "), 1)).over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "raw")))
    name = F.min_by(F.regexp_extract("raw", FILE_MARK, 1), F.when(F.col("raw").startswith("+++ "), F.col("seq")))
    whole = lines.groupBy(key, "section").agg(name.alias("file_path"), F.array_join(F.transform(ordered, lambda x: x["raw"]), "\n").alias("patch"))
    return whole.where(F.col("file_path").isNotNull() & (F.col("file_path") != "")).select(key, "file_path", "patch")


def fitting(files: DataFrame, group: str, order: str, size: str, cap: int) -> DataFrame:
    """The rows of each group kept by a greedy fold: a row that would exceed ``cap`` is skipped and does not count."""
    step = lambda acc, x: F.when(acc["total"] + x["size"] > cap, acc).otherwise(F.struct((acc["total"] + x["size"]).alias("total"), F.concat(acc["kept"], F.array(x["place"])).alias("kept")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("place"), F.col(size).cast("bigint").alias("size"))))
    kind = dict(files.dtypes)[order]
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast(f"array<{kind}>").alias("kept"))
    folded = files.groupBy(group).agg(F.aggregate(ordered, start, step).alias("fold"))
    return folded.select(group, F.explode("fold.kept").alias(order))


def on_valid_lines(comments: DataFrame, valid: DataFrame, keep: bool = True) -> DataFrame:
    """The comments whose (pr, file_path, line_number) is a line of the diff, or with ``keep`` false the others."""
    places = valid.select("repo_name", "pr_number", "file_path", F.col("new_line").alias("line_number")).distinct()
    return comments.join(places, ["repo_name", "pr_number", "file_path", "line_number"], "left_semi" if keep else "left_anti")
