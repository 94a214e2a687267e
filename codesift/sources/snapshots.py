"""Source trees, index tables and audit records: reading, replacing, copying, deleting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What of a source tree is read.
SUFFIXES = (".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs")
SKIPPED = ("node_modules", "__pycache__", ".git", "venv", ".venv", "dist", "build", ".next", ".tox", ".mypy_cache", ".pytest_cache", ".eggs", "vendor", "target")
UNREADABLE = "unreadable"


def read_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(file_path, hash, text) of the source files below ``root``; hidden and skipped directories are left out.

    Bytes that are no UTF-8 are replaced in the text, never in the hash.
    Spark's listing leaves out names that begin with a dot or an underscore
    (``__init__.py``); those files are listed here and read by their paths.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    system = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    listing, named = system.listFiles(spark._jvm.org.apache.hadoop.fs.Path(root), True), []
    while listing.hasNext():
        file = listing.next().getPath()
        inner = file.toUri().getPath()[len(base) + 1 :]
        if inner.endswith(suffixes) and any(part[0] in "._" for part in inner.split("/")):
            named.append(file.toString())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([root, *named])
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*/", "/"), "^" + base.replace(".", "\\.") + "/", "")
    names = F.split("file_path", "/")
    hidden = F.exists(names, lambda n: n.startswith(".") & (n != ".github"))
    skipped = F.exists(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(1))), lambda n: n.isin(*SKIPPED)) & (F.size(names) > 1)
    kept = files.select(path.alias("file_path"), "content").where(~hidden & ~skipped & F.col("file_path").rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    return kept.select("file_path", F.coalesce(F.sha2("content", 256), F.lit(UNREADABLE)).alias("hash"), F.decode("content", "UTF-8").alias("text"))


def matching(rows: DataFrame, equal: dict[str, object] | None = None, any_of: dict[str, list] | None = None) -> DataFrame:
    """Rows that equal all of ``equal`` and whose arrays hold one of each list in ``any_of``."""
    for name, value in (equal or {}).items():
        rows = rows.where(F.col(name) == F.lit(value))
    for name, values in (any_of or {}).items():
        rows = rows.where(F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in values])))
    return rows


def by_suffix(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``paths`` whose file_path ends with a wanted one or the other way, at a directory border.

    Both sides are keyed by their last name, so only paths of one name meet.
    """
    last = F.regexp_extract("file_path", r"[^/]*$", 0)
    right = wanted.select(F.col("file_path").alias("other")).distinct().withColumn("last", F.regexp_extract("other", r"[^/]*$", 0))
    ends = lambda a, b: (a == b) | F.endswith(a, F.concat(F.lit("/"), b))
    return paths.withColumn("last", last).join(right, "last").where(ends(F.col("file_path"), F.col("other")) | ends(F.col("other"), F.col("file_path"))).drop("last", "other").distinct()


def newest(rows: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """Upsert by append: of rows with equal keys the last written."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in at]))
    return rows.withColumn("place", place).where("place = 1").drop("place")


def replace_partitions(rows: DataFrame, path: str, column: str) -> None:
    """Write the partitions that ``rows`` hold and leave the others as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def without_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Deletion: the rows whose keys are not listed; null keys stay."""
    return rows.join(keys.distinct(), keys.columns, "left_anti")


def cascaded(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """The rows of ``children`` that go when ``parents`` are deleted; null keys stay."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def decoded(wire: Column) -> Column:
    """The text of base64 contents, whose lines may be broken; null where they are none."""
    return F.decode(F.try_to_binary(F.regexp_replace(wire, r"\s", ""), F.lit("base64")), "UTF-8")


def lookup(rows: DataFrame, paths: DataFrame, columns: list[str]) -> DataFrame:
    """(file_path, columns): what each of the given files has, whatever its repository; a file without rows has nulls."""
    return paths.select("file_path").distinct().join(rows.select("file_path", *columns), "file_path", "left")


def payloads(chunks: DataFrame, most: int = 3_000) -> DataFrame:
    """Chunks as they are stored beside their vectors: the content cut to the store's width, absent lists as empty ones."""
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return chunks.select("repo_name", "file_path", "chunk_type", F.coalesce("symbol_name", F.lit("")).alias("symbol_name"), "start_line", "end_line", *[listed(c) for c in ("symbols_defined", "symbols_called", "imports")], F.substring("content", 1, most).alias("content"), "content_hash")


def tree_text(leaves: DataFrame) -> DataFrame:
    """(repo_name, tree): the leaves of a repository as JSON, in order of path."""
    return leaves.groupBy("repo_name").agg(F.to_json(F.array_sort(F.collect_list(F.struct("file_path", "hash")))).alias("tree"))


def tree_rows(texts: DataFrame) -> DataFrame:
    """(repo_name, file_path, hash) of ``tree_text``."""
    return texts.select("repo_name", F.explode(F.from_json("tree", "ARRAY<STRUCT<file_path: STRING, hash: STRING>>")).alias("leaf")).select("repo_name", "leaf.*")


def copied(chunks: DataFrame, source: str, target: str) -> DataFrame:
    """The chunks of one repository under the name of another, with fresh ids."""
    rows = chunks.where(F.col("repo_name") == source)
    return rows.withColumn("repo_name", F.lit(target)).withColumn("copied_from", F.lit(source)).withColumn("id", F.expr("uuid()"))


def unexpired(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def audit_rows(findings: DataFrame) -> DataFrame:
    """Findings as they are stored: texts cut to the widths of the audit table."""
    return findings.select("review_id", F.col("agent").alias("agent_role"), F.upper(F.trim("severity")).alias("severity"), F.substring("file_path", 1, 500).alias("file_path"), "line_number", F.substring("category", 1, 500).alias("title"), F.substring("description", 1, 2000).alias("description"), F.substring("suggested_fix", 1, 2000).alias("suggestion"), "created_at")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """What a source that is out of reach gives: no rows of its schema."""
    return spark.createDataFrame([], schema)
