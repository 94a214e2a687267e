"""Queries on vectors, embeddings, symbols and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.operators import search, vector_index
from codesift.sources.tables import table


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks")


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100, against all."""
    vectors = table(spark, folder, "embeddings")
    return search.nearest_vectors(vectors, vectors.where("vec_id % 100 = 0"), 10).select("query_id", "vec_id", F.round("score", 4).alias("score"))


def vector_topk_scoped(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of a query's own label."""
    vectors = table(spark, folder, "embeddings")
    return search.nearest_vectors(vectors, vectors.where("vec_id % 100 = 0"), 5, within="label").select("query_id", "vec_id", F.round("score", 4).alias("score"))


def vector_topk_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The same by the index: exact scores of all vectors in the cells that a query looks into."""
    vectors = table(spark, folder, "embeddings")
    return vector_index.search(vectors, vectors.where("vec_id % 100 = 0"), 10, vector_index.fit_centroids(vectors))


def vector_topk_same_label(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the ten nearest have the query's label."""
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    near = vector_topk(spark, folder).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return near.groupBy("query_id").agg(F.count_if(F.col("label") == F.col("own")).alias("same"))


def label_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return search.centroids(table(spark, folder, "embeddings"), "label").select("label", F.col("dim").cast("bigint").alias("dim"), F.round("mean", 3).alias("mean"))


def embedding_texts(spark: SparkSession, folder: str) -> DataFrame:
    text = search.embedding_text(F.col("file_path"), F.col("symbol_name"), F.col("symbols_called"), F.col("imports"), F.col("content"))
    return _chunks(spark, folder).select("chunk_id", F.sha2(text.cast("binary"), 256).alias("text_hash"), F.length(text).alias("size"))


def _hashed(spark: SparkSession, folder: str) -> DataFrame:
    text = search.embedding_text(F.col("file_path"), F.col("symbol_name"), F.col("symbols_called"), F.col("imports"), F.col("content"))
    return _chunks(spark, folder).where("content IS NOT NULL").select("chunk_id", "repo_name", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), "indexed_at", text.alias("text"))


def _cache(spark: SparkSession, folder: str) -> DataFrame:
    """What the largest repository's index holds, as a cache."""
    chunks = _hashed(spark, folder)
    largest = chunks.groupBy("repo_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "repo_name").limit(1).select("repo_name")
    return chunks.join(largest, "repo_name", "left_semi").select("content_hash").distinct()


def embed_cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    looked = search.cache_lookup(_hashed(spark, folder), _cache(spark, folder))
    return looked.groupBy("repo_name").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.avg(F.col("hit").cast("int")), 4).alias("rate"))


def embed_missing(spark: SparkSession, folder: str) -> DataFrame:
    made = search.embed_missing(_hashed(spark, folder), _cache(spark, folder))
    return made.select("content_hash", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 3).alias("length"))


def symbol_callers(spark: SparkSession, folder: str) -> DataFrame:
    return search.calls_from_outside(_chunks(spark, folder)).groupBy("repo_name", "symbol").agg(F.countDistinct("called_in").alias("files"), F.countDistinct("chunk_id").alias("chunks"))


def file_dependents(spark: SparkSession, folder: str) -> DataFrame:
    return search.dependents(_chunks(spark, folder))


def blast_radius(spark: SparkSession, folder: str) -> DataFrame:
    """Files reached from those that any pull request changes."""
    changed = table(spark, folder, "pull_requests").select("repo_name", F.explode("changed_files").alias("file_path")).distinct()
    return search.blast_radius(changed, _chunks(spark, folder))


def context_callers(spark: SparkSession, folder: str) -> DataFrame:
    """The first five calling files of each symbol, as shown beside a change."""
    rows = search.calls_from_outside(_chunks(spark, folder)).select("repo_name", "symbol", "called_in").distinct()
    return search.first_few(rows, ["repo_name", "symbol"], ["called_in"], 5)


def import_usage(spark: SparkSession, folder: str) -> DataFrame:
    return search.symbol_index(_chunks(spark, folder), "imports").groupBy("symbol").agg(F.countDistinct("repo_name").alias("repos"), F.countDistinct("file_path").alias("files"))


def code_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """Per file its functions, classes and imports, sorted and distinct, and the number of its nodes."""
    kind = F.lower(F.trim("chunk_type"))
    rows = _chunks(spark, folder).select("repo_name", "file_path", kind.alias("kind"), F.coalesce("symbols_defined", F.array().cast("array<string>")).alias("d"), F.coalesce("imports", F.array().cast("array<string>")).alias("m"))
    folded = rows.groupBy("repo_name", "file_path").agg(F.collect_set(F.when(F.col("kind") == "function", F.col("d"))).alias("f"), F.collect_set(F.when(F.col("kind") == "class_header", F.col("d"))).alias("c"), F.collect_set("m").alias("i"))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(c)))
    out = folded.select("repo_name", "file_path", flat("f").alias("functions"), flat("c").alias("classes"), flat("i").alias("imports"))
    return out.withColumn("node_count", (F.size("functions") + F.size("classes")).cast("bigint"))


def call_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Files reached from a file over calls in at most three hops, counted."""
    edges = search.callers(_chunks(spark, folder)).select(F.concat_ws(":", "repo_name", "called_in").alias("src"), F.concat_ws(":", "repo_name", "defined_in").alias("dst")).distinct()
    return search.transitive(edges, 3).groupBy("src", "hops").agg(F.count(F.lit(1)).alias("files"))


_TEXT = """concat_ws(chr(10), CASE WHEN length(file_path) > 0 THEN 'File: ' || file_path END, CASE WHEN length(symbol_name) > 0 THEN 'Symbol: ' || symbol_name END,
  CASE WHEN length(array_to_string(coalesce(symbols_called, [])[1:15], ', ')) > 0 THEN 'Calls: ' || array_to_string(symbols_called[1:15], ', ') END,
  CASE WHEN length(array_to_string(coalesce(imports, [])[1:10], ', ')) > 0 THEN 'Imports: ' || array_to_string(imports[1:10], ', ') END, array_to_string(string_split(coalesce(content, ''), '')[1:1500], ''))"""
_TEXT = _TEXT.replace("array_to_string(string_split(coalesce(content, ''), '')[1:1500], '')", "substring(coalesce(content, ''), 1, 1500)")
_TOP = "q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings e ON e.vec_id <> q.vec_id), top AS (SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM s) WHERE nth <= 10)"
_CACHE = "h AS (SELECT chunk_id, repo_name, sha256(content) AS content_hash FROM chunks WHERE content IS NOT NULL), cache AS (SELECT DISTINCT content_hash FROM h WHERE repo_name = (SELECT repo_name FROM h GROUP BY 1 ORDER BY count(*) DESC, repo_name LIMIT 1))"
_CALLS = "def AS (SELECT DISTINCT repo_name, unnest(symbols_defined) AS symbol, file_path AS defined_in FROM chunks), cal AS (SELECT DISTINCT repo_name, unnest(symbols_called) AS symbol, chunk_id, file_path AS called_in FROM chunks), callers AS (SELECT repo_name, symbol, defined_in, called_in, chunk_id FROM cal JOIN def USING (repo_name, symbol) WHERE defined_in <> called_in)"
_DEPS = "names AS (SELECT DISTINCT repo_name, file_path, unnest([file_path, replace(replace(file_path, '/', '.'), '.py', ''), regexp_extract(regexp_replace(file_path, '\\.[A-Za-z0-9]+$', ''), '[^/]*$')]) AS symbol FROM chunks), used AS (SELECT DISTINCT repo_name, unnest(imports) AS symbol, file_path AS dependent FROM chunks), deps AS (SELECT DISTINCT repo_name, file_path, dependent FROM names JOIN used USING (repo_name, symbol) WHERE file_path <> dependent)"

QUERIES = {q.__name__: q for q in (vector_topk, vector_topk_scoped, vector_topk_indexed, vector_topk_same_label, label_centroids, embedding_texts, embed_cache_hits, embed_missing, symbol_callers, file_dependents, blast_radius, context_callers, import_usage, code_graphs, call_closure)}
SQL = {
    "vector_topk": f"WITH {_TOP} SELECT query_id, vec_id, round(score, 4) AS score FROM top",
    "vector_topk_scoped": "WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings e ON e.vec_id <> q.vec_id AND e.label = q.label) SELECT query_id, vec_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM s) WHERE nth <= 5",
    "vector_topk_same_label": f"WITH {_TOP} SELECT query_id, count(*) FILTER (a.label = b.label) AS same FROM top JOIN embeddings a ON a.vec_id = top.vec_id JOIN embeddings b ON b.vec_id = query_id GROUP BY 1",
    "label_centroids": "SELECT label, dim, round(avg(x::DOUBLE), 3) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY ALL",
    "embedding_texts": f"SELECT chunk_id, sha256({_TEXT}) AS text_hash, length({_TEXT})::INT AS size FROM chunks",
    "embed_cache_hits": f"WITH {_CACHE} SELECT repo_name, count(c.content_hash) AS hits, count(*) - count(c.content_hash) AS misses, round(count(c.content_hash) / count(*), 4) AS rate FROM h LEFT JOIN cache c USING (content_hash) GROUP BY 1",
    "symbol_callers": f"WITH {_CALLS} SELECT repo_name, symbol, count(DISTINCT called_in) AS files, count(DISTINCT chunk_id) AS chunks FROM callers GROUP BY ALL",
    "file_dependents": f"WITH {_DEPS} SELECT * FROM deps",
    "blast_radius": f"WITH {_CALLS}, {_DEPS}, ch AS (SELECT DISTINCT repo_name, unnest(changed_files) AS f FROM pull_requests) SELECT repo_name, f AS changed, dependent AS reached, 'import' AS why FROM deps JOIN ch USING (repo_name) WHERE file_path = f UNION SELECT repo_name, f, called_in, 'call' FROM callers JOIN ch USING (repo_name) WHERE defined_in = f",
    "context_callers": f"WITH {_CALLS}, d AS (SELECT DISTINCT repo_name, symbol, called_in FROM callers) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, symbol ORDER BY called_in) AS place FROM d) WHERE place <= 5",
    "import_usage": "SELECT symbol, count(DISTINCT repo_name) AS repos, count(DISTINCT file_path) AS files FROM (SELECT repo_name, file_path, unnest(imports) AS symbol FROM chunks) GROUP BY 1",
    "code_graphs": "WITH x AS (SELECT DISTINCT repo_name, file_path FROM chunks), n AS (SELECT repo_name, file_path, list_sort(coalesce(list_distinct(flatten(list(coalesce(symbols_defined, [])) FILTER (lower(trim(chunk_type)) = 'function'))), [])) AS functions, list_sort(coalesce(list_distinct(flatten(list(coalesce(symbols_defined, [])) FILTER (lower(trim(chunk_type)) = 'class_header'))), [])) AS classes, list_sort(list_distinct(flatten(list(coalesce(imports, []))))) AS imports FROM chunks GROUP BY ALL) SELECT *, (len(functions) + len(classes))::BIGINT AS node_count FROM n",
    "call_closure": f"WITH {_CALLS}, e AS (SELECT DISTINCT repo_name || ':' || called_in AS src, repo_name || ':' || defined_in AS dst FROM callers), e2 AS (SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src), e3 AS (SELECT DISTINCT a.src, b.dst FROM (SELECT * FROM e2 EXCEPT SELECT * FROM e) a JOIN e b ON a.dst = b.src), l AS (SELECT src, dst, min(hops) AS hops FROM (SELECT src, dst, 1 AS hops FROM e UNION ALL SELECT src, dst, 2 FROM e2 UNION ALL SELECT src, dst, 3 FROM e3) GROUP BY ALL) SELECT src, hops, count(*) AS files FROM l GROUP BY ALL",
}
