"""Queries on hash trees of repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.operators import trees
from codesift.sources.tables import table

LEVELS = 12  # depth to which the SQL twin of the directory hash is unrolled


def _leaves(spark: SparkSession, folder: str) -> DataFrame:
    return trees.leaf_hashes(trees.file_texts(table(spark, folder, "chunks")))


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "index_stats")
    return runs.where("simhash_source IS NOT NULL AND repo_name IS NOT NULL AND simhash_source <> repo_name").select("repo_name", F.col("simhash_source").alias("source")).distinct()


def leaf_hash_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return _leaves(spark, folder)


def dir_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return trees.directory_hashes(_leaves(spark, folder)).select("repo_name", "dir", "depth", "hash", "files")


def root_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return trees.directory_hashes(_leaves(spark, folder)).where("depth = 0").select("repo_name", "hash", "files")


def subtree_file_counts(spark: SparkSession, folder: str) -> DataFrame:
    return trees.subtree_counts(_leaves(spark, folder))


def tree_diff_with_source(spark: SparkSession, folder: str) -> DataFrame:
    leaves, sources = _leaves(spark, folder), _sources(spark, folder)
    pair = F.concat_ws(">", "source", "repo_name")
    new = leaves.join(sources, "repo_name").withColumn("pair", pair)
    old = leaves.withColumnRenamed("repo_name", "source").join(sources, "source").withColumn("pair", pair)
    return trees.tree_diff(old, new, "pair")


def changed_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tree_diff_with_source(spark, folder).groupBy("pair", "change").agg(F.count(F.lit(1)).alias("files"))


def reusable_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that a repository may take over from its source: those of files that did not change."""
    leaves, sources = _leaves(spark, folder), _sources(spark, folder)
    same = leaves.join(sources, "repo_name").join(leaves.withColumnRenamed("repo_name", "source"), ["source", "file_path", "hash"], "left_semi").select("source", "repo_name", "file_path").distinct()
    chunks = table(spark, folder, "chunks").select(F.col("repo_name").alias("source"), "file_path", "chunk_id")
    return chunks.join(same, ["source", "file_path"]).select("chunk_id", "repo_name", F.col("source").alias("copied_from"))


def stale_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of a repository in files that its source has otherwise or not at all: to be made anew."""
    changed = tree_diff_with_source(spark, folder).where("change <> 'deleted'").select(F.element_at(F.split("pair", ">"), 2).alias("repo_name"), "file_path").distinct()
    return table(spark, folder, "chunks").select("chunk_id", "repo_name", "file_path").join(changed, ["repo_name", "file_path"], "left_semi").select("chunk_id")


def simhash_per_repo(spark: SparkSession, folder: str) -> DataFrame:
    return trees.simhash(_leaves(spark, folder))


def _hashes(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_per_repo(spark, folder).withColumn("tenant", F.lit("all"))


def similar_repos(spark: SparkSession, folder: str) -> DataFrame:
    return trees.similar_collections(_hashes(spark, folder), "tenant", most=80).select("repo_name_a", "repo_name_b", "distance")


def nearest_repo(spark: SparkSession, folder: str) -> DataFrame:
    return trees.nearest_collection(_hashes(spark, folder), "tenant", most=80)


def _top_directories(spark: SparkSession, folder: str) -> DataFrame:
    """The hashes of the top-level directories of all repositories, as collections of their own."""
    leaves = _leaves(spark, folder)
    named = leaves.withColumn("repo_name", F.concat_ws("/", "repo_name", F.split("file_path", "/")[0]))
    return trees.simhash(named).withColumn("tenant", F.lit("all"))


def similar_directories(spark: SparkSession, folder: str) -> DataFrame:
    return trees.similar_collections(_top_directories(spark, folder), "tenant").select("repo_name_a", "repo_name_b", "distance")


def nearest_directory(spark: SparkSession, folder: str) -> DataFrame:
    return trees.nearest_collection(_top_directories(spark, folder), "tenant")


def distance_to_source(spark: SparkSession, folder: str) -> DataFrame:
    hashes = simhash_per_repo(spark, folder).select("repo_name", "simhash")
    other = hashes.select(F.col("repo_name").alias("source"), F.col("simhash").alias("theirs"))
    pairs = _sources(spark, folder).join(hashes, "repo_name").join(other, "source")
    return pairs.select("repo_name", "source", trees.hamming(F.col("simhash"), F.col("theirs")).alias("distance"))


def content_hash_groups(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").where("content IS NOT NULL")
    return chunks.groupBy(F.sha2(F.col("content").cast("binary"), 256).alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("repo_name").alias("repos")).where("copies > 1")


def content_hash_check(spark: SparkSession, folder: str) -> DataFrame:
    stored, real = F.lower("content_hash"), F.sha2(F.col("content").cast("binary"), 256)
    state = F.when(F.col("content_hash").isNull(), "missing").when(stored == real, F.when(F.col("content_hash") == real, "equal").otherwise("other case")).otherwise("wrong")
    return table(spark, folder, "chunks").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("chunks"))


_TEXTS = """
parts AS (SELECT repo_name, file_path, chunk_index, max(content) AS content FROM chunks GROUP BY ALL),
texts AS (SELECT repo_name, file_path, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM parts GROUP BY ALL),
leaves AS (SELECT repo_name, file_path, sha256(coalesce(text, '')) AS hash FROM texts),
sources AS (SELECT DISTINCT repo_name, simhash_source AS source FROM index_stats WHERE simhash_source IS NOT NULL AND repo_name IS NOT NULL AND simhash_source <> repo_name)"""
_DIRS = "WITH" + _TEXTS + ",\nnodes AS (SELECT repo_name, regexp_replace(file_path, '/?[^/]*$', '') AS dir, regexp_extract(file_path, '[^/]*$') AS name, hash, 1::BIGINT AS files, len(string_split(file_path, '/')) - 1 AS depth FROM leaves)"
for _d in range(LEVELS, -1, -1):
    _below = f" UNION ALL SELECT repo_name, regexp_replace(dir, '/?[^/]*$', ''), regexp_extract(dir, '[^/]*$'), hash, files FROM l{_d + 1}" if _d < LEVELS else ""
    _DIRS += f",\ne{_d} AS (SELECT repo_name, dir, name, hash, files FROM nodes WHERE depth = {_d}{_below}),\nl{_d} AS (SELECT repo_name, dir, {_d} AS depth, sha256(string_agg(name || ':' || hash || chr(10), '' ORDER BY name)) AS hash, sum(files)::BIGINT AS files FROM e{_d} GROUP BY repo_name, dir)"
_EVERY = " UNION ALL ".join(f"SELECT repo_name, dir, depth, hash, files FROM l{d}" for d in range(LEVELS + 1))
_PAIRS = "WITH" + _TEXTS + """,
n AS (SELECT source || '>' || repo_name AS pair, file_path, hash FROM leaves JOIN sources USING (repo_name)),
o AS (SELECT s.source || '>' || s.repo_name AS pair, file_path, hash FROM leaves l JOIN sources s ON l.repo_name = s.source),
d AS (SELECT coalesce(o.pair, n.pair) AS pair, coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'deleted' ELSE 'modified' END AS change
  FROM o FULL JOIN n ON o.pair = n.pair AND o.file_path = n.file_path WHERE o.hash IS DISTINCT FROM n.hash)
"""
_SIM = "WITH" + _TEXTS + """,
bits AS (SELECT repo_name, b, sum(CASE WHEN (instr('0123456789abcdef', substr(hash, b // 4 + 1, 1)) - 1) & (8 >> (b % 4)) > 0 THEN 1 ELSE -1 END) AS s FROM leaves, range(256) t(b) GROUP BY ALL),
digits AS (SELECT repo_name, b // 4 AS nib, sum(CASE WHEN s > 0 THEN 8 >> (b % 4) ELSE 0 END)::INT AS d FROM bits GROUP BY ALL),
sims AS (SELECT repo_name, string_agg(substr('0123456789abcdef', d + 1, 1), '' ORDER BY nib) AS simhash FROM digits GROUP BY 1),
counted AS (SELECT repo_name, count(*) AS files FROM leaves GROUP BY 1),
pairs AS (SELECT a.repo_name AS repo_name_a, b.repo_name AS repo_name_b, (SELECT sum(bit_count((instr('0123456789abcdef', substr(a.simhash, i, 1)) - 1)::INT # (instr('0123456789abcdef', substr(b.simhash, i, 1)) - 1)::INT)) FROM range(1, 65) t(i))::INT AS distance
  FROM sims a JOIN sims b ON a.repo_name < b.repo_name),
near AS (SELECT * FROM pairs WHERE distance <= 80)
"""
_SIM = _SIM.replace("::INT # (", "::INT, (").replace("bit_count((instr", "bit_count(xor((instr").replace("- 1)::INT)) FROM range", "- 1)::INT))) FROM range")

_SIM_TOP = _SIM.replace("FROM leaves, range", "FROM tops, range").replace("FROM leaves GROUP", "FROM tops GROUP").replace("\nbits AS", "\ntops AS (SELECT concat_ws('/', repo_name, split_part(file_path, '/', 1)) AS repo_name, hash FROM leaves),\nbits AS").replace("distance <= 80", "distance <= 25")
_NEAREST = "SELECT repo_name, nearest, distance FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY distance, nearest) AS nth FROM (SELECT repo_name_a AS repo_name, repo_name_b AS nearest, distance FROM near UNION ALL SELECT repo_name_b, repo_name_a, distance FROM near)) WHERE nth = 1"

QUERIES = {q.__name__: q for q in (leaf_hash_catalog, dir_hashes, root_hashes, subtree_file_counts, tree_diff_with_source, changed_counts, reusable_chunks, stale_chunks, simhash_per_repo, similar_repos, nearest_repo, similar_directories, nearest_directory, distance_to_source, content_hash_groups, content_hash_check)}
SQL = {
    "leaf_hash_catalog": "WITH" + _TEXTS + " SELECT * FROM leaves",
    "dir_hashes": _DIRS + f" SELECT * FROM ({_EVERY})",
    "root_hashes": _DIRS + " SELECT repo_name, hash, files FROM l0",
    "subtree_file_counts": "WITH" + _TEXTS + ", s AS (SELECT repo_name, string_split(file_path, '/') AS p FROM leaves) SELECT repo_name, array_to_string(p[1:n], '/') AS dir, count(*) AS files FROM (SELECT repo_name, p, unnest(range(len(p))) AS n FROM s) GROUP BY ALL",
    "tree_diff_with_source": _PAIRS + "SELECT * FROM d",
    "changed_counts": _PAIRS + "SELECT pair, change, count(*) AS files FROM d GROUP BY ALL",
    "reusable_chunks": "WITH" + _TEXTS + " SELECT c.chunk_id, s.repo_name, s.source AS copied_from FROM sources s JOIN leaves n ON n.repo_name = s.repo_name JOIN leaves o ON o.repo_name = s.source AND o.file_path = n.file_path AND o.hash = n.hash JOIN chunks c ON c.repo_name = s.source AND c.file_path = n.file_path",
    "stale_chunks": _PAIRS + "SELECT chunk_id FROM chunks WHERE (repo_name, file_path) IN (SELECT (string_split(pair, '>')[2], file_path) FROM d WHERE change <> 'deleted')",
    "simhash_per_repo": _SIM + "SELECT repo_name, simhash, files FROM sims JOIN counted USING (repo_name)",
    "similar_repos": _SIM + "SELECT * FROM near",
    "nearest_repo": _SIM + _NEAREST,
    "similar_directories": _SIM_TOP + "SELECT * FROM near",
    "nearest_directory": _SIM_TOP + _NEAREST,
    "distance_to_source": _SIM + "SELECT s.repo_name, s.source, distance FROM sources s JOIN pairs p ON (p.repo_name_a = s.repo_name AND p.repo_name_b = s.source) OR (p.repo_name_b = s.repo_name AND p.repo_name_a = s.source)",
    "content_hash_groups": "SELECT sha256(content) AS hash, count(*) AS copies, count(DISTINCT repo_name) AS repos FROM chunks WHERE content IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "content_hash_check": "SELECT CASE WHEN content_hash IS NULL THEN 'missing' WHEN content_hash = sha256(content) THEN 'equal' WHEN lower(content_hash) = sha256(content) THEN 'other case' ELSE 'wrong' END AS state, count(*) AS chunks FROM chunks GROUP BY 1",
}
