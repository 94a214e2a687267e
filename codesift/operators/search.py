"""Vector search, embedding reuse, and retrieval by symbols and imports."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesift.functions.vectors import norm

PARTIAL = "query_id BIGINT, vec_id BIGINT, score DOUBLE"


def _scores(queries, ids: np.ndarray, scopes: np.ndarray | None, k: int, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = queries.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype=np.int64), np.empty(0)) for _ in ids]
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            rows /= np.linalg.norm(rows, axis=1, keepdims=True)
            own = batch["vec_id"].to_numpy()
            for start in range(0, len(ids), block):
                part = matrix[start : start + block] @ rows.T
                if scopes is not None:
                    part[scopes[start : start + block, None] != batch["scope"].to_numpy(dtype=object)[None, :]] = -2.0
                for q in range(len(part)):
                    row = part[q]
                    keep = np.argpartition(-row, k)[: k + 1] if len(row) > k + 1 else np.arange(len(row))
                    # equal scores at the edge go to the smaller id, so all of them stay until the end
                    keep = np.flatnonzero(row >= row[keep].min() - 1e-9) if len(row) > k + 1 else keep
                    seen, score = best[start + q]
                    seen, score = np.concatenate([seen, own[keep]]), np.concatenate([score, row[keep]])
                    order = np.lexsort((seen, -np.round(score, 6)))[: k + 1]
                    best[start + q] = seen[order], score[order]
        for q, (seen, score) in zip(ids, best, strict=True):
            seen, score = seen[score > -1.5], score[score > -1.5]
            if len(seen):
                yield pd.DataFrame({"query_id": np.full(len(seen), q), "vec_id": seen, "score": score})

    return run


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, max_queries: int = 10_000, block: int = 256, within: str | None = None) -> DataFrame:
    """(query_id, vec_id, score, place): the ``k`` vectors of the highest cosine for each query, itself left out.

    With ``within``, a column of both, only vectors that have the query's value
    there are looked at, a repository's own for example; null is no value.

    Exact.  Queries are sent to the vectors in groups of at most
    ``max_queries``; within a task they are multiplied in blocks, and only the
    best k of a task go on to the final ranking.  Null, empty and zero vectors
    take no part; equal scores (to six places) are ordered by id.
    """
    scope = [F.col(within).cast("string").alias("scope")] if within else []
    fits = (F.size("embedding") > 0) & (norm(F.col("embedding")) > 0)
    usable, asked = (df.select("vec_id", "embedding", *scope).where(fits & F.col("scope").isNotNull() if within else fits) for df in (vectors, queries))
    groups = max(1, -(-asked.count() // max_queries))
    found = None
    for g in range(groups):
        pdf = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).toPandas() if groups > 1 else asked.toPandas()
        if not len(pdf):
            continue
        matrix = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        sent = vectors.sparkSession.sparkContext.broadcast(matrix)
        part = usable.mapInPandas(_scores(sent, pdf["vec_id"].to_numpy(), pdf["scope"].to_numpy(dtype=object) if within else None, k, block), PARTIAL)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], PARTIAL)
    score = F.round("score", 6)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(score.desc(), "vec_id"))
    return found.where("vec_id <> query_id").withColumn("place", place).where(F.col("place") <= k).select("query_id", "vec_id", score.alias("score"), F.col("place").cast("bigint").alias("place"))


def centroids(vectors: DataFrame, label: str) -> DataFrame:
    """(label, dim, mean): the mean of each coordinate per label."""
    cells = vectors.select(label, F.posexplode("embedding").alias("dim", "x"))
    return cells.groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def embedding_text(path: Column, symbol: Column, calls: Column, imports: Column, content: Column) -> Column:
    """The text that is embedded for a chunk: where it is, what it calls and imports, and its head."""
    line = lambda name, value: F.when(F.length(value) > 0, F.concat(F.lit(f"{name}: "), value))
    listed = lambda c, n: F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), ", ")
    return F.concat_ws("\n", line("File", path), line("Symbol", symbol), line("Calls", listed(calls, 15)), line("Imports", listed(imports, 10)), F.substring(F.coalesce(content, F.lit("")), 1, 1500))


_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def embed_text(text: str | None, dim: int) -> np.ndarray:
    """Feature hashing of words with signs, at unit length; a blank text is the zero vector."""
    out = np.zeros(dim, dtype=np.float32)
    for word in _WORD.findall(text or ""):
        h = int.from_bytes(hashlib.blake2b(word.lower().encode(), digest_size=8).digest(), "little")
        out[h % dim] += 1.0 if h >> 63 else -1.0
    size = np.linalg.norm(out)
    return out / size if size else out


def hash_embedder(dim: int = 384):
    """A pandas UDF from texts to vectors; another model is put in by passing another function to ``embed_missing``."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([embed_text(t, dim) for t in texts])

    return F.pandas_udf(embed, "array<float>", F.PandasUDFType.SCALAR_ITER)


def _fresh(cache: DataFrame, now: Column | None) -> DataFrame:
    """The hashes of the cache, without those that ran out before ``now`` (a cache without ``expires_at``, or null, never runs out)."""
    if now is not None and "expires_at" in cache.columns:
        cache = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return cache.select("content_hash").distinct()


def cache_lookup(chunks: DataFrame, cache: DataFrame, now: Column | None = None) -> DataFrame:
    """The chunks with ``hit``: whether their content hash has an embedding that has not run out."""
    known = _fresh(cache, now).withColumn("hit", F.lit(True))
    return chunks.join(known, "content_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def embed_missing(chunks: DataFrame, cache: DataFrame, embed=None, now: Column | None = None) -> DataFrame:
    """(content_hash, embedding) of each text that the cache lacks, once per text."""
    missing = chunks.join(_fresh(cache, now), "content_hash", "left_anti")
    texts = missing.groupBy("content_hash").agg(F.min("text").alias("text"))
    return texts.select("content_hash", (embed or hash_embedder())(F.col("text")).alias("embedding"))


def last_segment(name: Column) -> Column:
    """What stands after the last dot of a dotted name; null where that is no identifier."""
    last = F.element_at(F.split(name, r"\."), -1)
    return F.when(last.rlike(r"^[A-Za-z_]\w*$"), last)


def symbol_index(chunks: DataFrame, column: str) -> DataFrame:
    """(repo_name, symbol, chunk_id, file_path): the inverted index of an array column."""
    return chunks.select("repo_name", "chunk_id", "file_path", F.explode(F.array_distinct(column)).alias("symbol"))


def callers(chunks: DataFrame) -> DataFrame:
    """(repo_name, symbol, file_path, caller, called_in): chunks of other files that call what a file defines."""
    defined = symbol_index(chunks, "symbols_defined").select("repo_name", "symbol", F.col("file_path").alias("defined_in")).distinct()
    called = symbol_index(chunks, "symbols_called").select("repo_name", "symbol", "chunk_id", F.col("file_path").alias("called_in"))
    return called.join(defined, ["repo_name", "symbol"]).where(F.col("defined_in") != F.col("called_in")).select("repo_name", "symbol", "defined_in", "called_in", "chunk_id")


def calls_from_outside(chunks: DataFrame) -> DataFrame:
    """(repo_name, symbol, called_in, chunk_id): the calls of what another file defines, once each, however many files define it.

    A symbol's definers are reduced to one row before the join, so a common
    name does not pair all its definers with all its callers.
    """
    defined = symbol_index(chunks, "symbols_defined").groupBy("repo_name", "symbol").agg(F.min("file_path").alias("first"), F.max("file_path").alias("last"))
    called = symbol_index(chunks, "symbols_called").select("repo_name", "symbol", "chunk_id", F.col("file_path").alias("called_in"))
    elsewhere = (F.col("first") != F.col("called_in")) | (F.col("last") != F.col("called_in"))
    return called.join(defined, ["repo_name", "symbol"]).where(elsewhere).select("repo_name", "symbol", "called_in", "chunk_id")


def module_names(path: Column) -> Column:
    """What an import may name a file by: its path, its dotted path without suffix, and its bare name."""
    bare = F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")
    return F.array_distinct(F.array(path, F.replace(F.replace(path, F.lit("/"), F.lit(".")), F.lit(".py"), F.lit("")), F.regexp_extract(bare, r"[^/]*$", 0)))


def dependents(chunks: DataFrame) -> DataFrame:
    """(repo_name, file_path, dependent): the files that import a file of their repository."""
    files = chunks.select("repo_name", "file_path").distinct()
    names = files.select("repo_name", "file_path", F.explode(module_names(F.col("file_path"))).alias("symbol"))
    used = symbol_index(chunks, "imports").select("repo_name", "symbol", F.col("file_path").alias("dependent")).distinct()
    return names.join(used, ["repo_name", "symbol"]).where(F.col("file_path") != F.col("dependent")).select("repo_name", "file_path", "dependent").distinct()


def blast_radius(changed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(repo_name, changed, reached, why): files reached in one hop from changed ones, by import or by call."""
    imports = dependents(chunks).join(changed, ["repo_name", "file_path"]).select("repo_name", F.col("file_path").alias("changed"), F.col("dependent").alias("reached"), F.lit("import").alias("why"))
    calls = callers(chunks).join(changed.withColumnRenamed("file_path", "defined_in"), ["repo_name", "defined_in"]).select("repo_name", F.col("defined_in").alias("changed"), F.col("called_in").alias("reached"), F.lit("call").alias("why"))
    return imports.unionByName(calls).distinct()


def first_few(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place.cast("bigint")).where(F.col("place") <= k)


def transitive(edges: DataFrame, rounds: int) -> DataFrame:
    """(src, dst, hops): everything reached in at most ``rounds`` hops, by the fewest."""
    found = edges.select("src", "dst", F.lit(1).alias("hops")).distinct()
    frontier = found
    for hop in range(2, rounds + 1):
        step = frontier.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        frontier = step.join(found.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(hop).alias("hops"))
        found = found.unionByName(frontier)
    return found
