"""Index pipelines: building and refreshing the chunk index of many repositories at once.

A run compares the hash trees of the files as they are with those of the index,
or, for a repository that is new, with those of a similar one; unchanged files
keep or copy their chunks, the others are chunked and embedded, and texts that
the embedding cache knows are not embedded again.  Everything is a join or an
aggregation over all repositories; the parts of a run share one comparison.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.operators import chunking, search, trees

# Fixed value: repositories of more files are skipped.
MOST_FILES = 5_000


@dataclass(frozen=True)
class IndexRun:
    """``stats`` per repository; ``fresh`` chunks; ``copied`` and ``removed`` (repo_name, file_path, ...) of the index; ``vectors`` that the cache lacked."""

    stats: DataFrame
    changes: DataFrame
    fresh: DataFrame
    copied: DataFrame
    removed: DataFrame
    vectors: DataFrame


def base_leaves(leaves: DataFrame, known: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo_name, file_path, hash, source): what each repository is compared with: its own tree in the index, or else that of its source."""
    repos = leaves.select("repo_name").distinct()
    own = known.join(repos, "repo_name", "left_semi").select("repo_name", "file_path", "hash", F.lit(None).cast("string").alias("source"))
    new = sources.join(repos, "repo_name", "left_semi").join(known.select("repo_name").distinct(), "repo_name", "left_anti").groupBy("repo_name").agg(F.min("source").alias("source"))
    theirs = known.select(F.col("repo_name").alias("source"), "file_path", "hash").join(new, "source").select("repo_name", "file_path", "hash", "source")
    return own.unionByName(theirs)


def run_index(files: DataFrame, known: DataFrame, sources: DataFrame, cache: DataFrame, chunker: Callable[[DataFrame], DataFrame] = chunking.chunk_files, embed=None, most_files: int = MOST_FILES, now: Column | None = None) -> IndexRun:
    """One run over all repositories in ``files`` (repo_name, file_path, text).

    ``known`` (repo_name, file_path, hash) are the trees of the index, ``sources``
    (repo_name, source) names a similar repository for each, ``cache``
    (content_hash, ...) the embeddings.  A repository of more than
    ``most_files`` files is skipped and says so.
    """
    leaves = trees.leaf_hashes(files)
    sizes = leaves.groupBy("repo_name").agg(F.count(F.lit(1)).alias("total_files")).withColumn("skipped", F.col("total_files") > most_files)
    taken = leaves.join(sizes.where("NOT skipped").select("repo_name"), "repo_name", "left_semi")
    base = base_leaves(taken, known, sources)
    changes = trees.tree_diff(base, taken, "repo_name")
    stale = changes.where("change <> 'deleted'").select("repo_name", "file_path")
    made = chunker(files.join(stale, ["repo_name", "file_path"], "left_semi"))
    made = made.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    looked = search.cache_lookup(made.withColumn("text", F.coalesce("content", F.lit(""))), cache, now)
    vectors = search.embed_missing(looked.select("content_hash", "text"), cache, embed, now)
    same = taken.join(base.where("source IS NOT NULL"), ["repo_name", "file_path", "hash"]).select("repo_name", "source", "file_path")
    removed = changes.where("change <> 'added'").join(base.where("source IS NULL").select("repo_name").distinct(), "repo_name", "left_semi").select("repo_name", "file_path")
    count = lambda df, *of: df.groupBy("repo_name").agg(*of)
    stats = sizes.join(count(changes, F.count(F.lit(1)).alias("files_changed")), "repo_name", "left")
    stats = stats.join(count(looked, F.count(F.lit(1)).alias("total_chunks"), F.count_if(~F.col("hit")).alias("chunks_embedded"), F.count_if("hit").alias("chunks_cached")), "repo_name", "left")
    stats = stats.join(count(same, F.count(F.lit(1)).alias("files_copied"), F.min("source").alias("simhash_source")), "repo_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    reason = F.when(F.col("skipped"), F.concat(F.lit("more files than "), F.lit(str(most_files))))
    stats = stats.select("repo_name", "total_files", *[zero(c) for c in ("files_changed", "total_chunks", "chunks_embedded", "chunks_cached", "files_copied")], "simhash_source", reason.alias("skipped_reason"))
    return IndexRun(stats, changes, made, same, removed, vectors)


def applied(index: DataFrame, run: IndexRun) -> DataFrame:
    """The chunk index after a run: without the chunks of changed and deleted files, with copied and fresh ones.

    ``index`` has (repo_name, file_path, chunk_index, content_hash, content).
    """
    columns = ["repo_name", "file_path", "chunk_index", "content_hash", "content"]
    left = index.select(*columns).join(run.removed, ["repo_name", "file_path"], "left_anti")
    copies = index.select(F.col("repo_name").alias("source"), *columns[1:]).join(run.copied, ["source", "file_path"]).select(*columns, F.col("source").alias("copied_from"))
    stay = left.withColumn("copied_from", F.lit(None).cast("string"))
    return stay.unionByName(copies).unionByName(run.fresh.select(*columns).withColumn("copied_from", F.lit(None).cast("string")))
