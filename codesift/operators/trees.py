"""Content hash trees, their differences, and 256-bit SimHash of file collections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesift.runtime import write_table

EMPTY_TREE = "empty"
BITS = 256


def file_texts(chunks: DataFrame) -> DataFrame:
    """(repo_name, file_path, text, chunks): the parts of each file in order, one blank line between; repeated parts count once."""
    parts = chunks.groupBy("repo_name", "file_path", "chunk_index").agg(F.max("content").alias("content"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    text = F.array_join(F.transform(ordered, lambda p: p["content"]), "\n\n")
    return parts.groupBy("repo_name", "file_path").agg(text.alias("text"), F.count(F.lit(1)).alias("chunks"))


def leaf_hashes(files: DataFrame) -> DataFrame:
    """(repo_name, file_path, hash) by SHA-256 of the text; an absent text hashes as an empty one."""
    return files.select("repo_name", "file_path", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def depth_of(path: Column) -> Column:
    """Number of directories above a file, or of names in a directory's path."""
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "/")))


def directory_hashes(leaves: DataFrame) -> DataFrame:
    """(repo_name, dir, depth, hash, files): a directory hashes the sorted ``name:hash`` lines of its entries.

    Levels are folded from the deepest up, one grouped aggregation each; there
    are as many as the deepest path has directories.  Each level is written,
    so that no level computes those below it again.
    """
    nodes = leaves.select("repo_name", F.col("file_path").alias("path"), "hash", F.lit(1).cast("bigint").alias("files"))
    nodes = write_table(nodes.withColumn("depth", depth_of(F.col("path")) - 1).withColumn("dir", parent_of(F.col("path"))), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.select("repo_name", "dir", "depth", "hash", "files")
    found, below = None, None
    for depth in range(deepest, -1, -1):
        entries = nodes.where(F.col("depth") == depth).select("repo_name", "dir", name_of(F.col("path")).alias("name"), "hash", "files")
        if below is not None:
            entries = entries.unionByName(below.select("repo_name", parent_of(F.col("dir")).alias("dir"), name_of(F.col("dir")).alias("name"), "hash", "files"))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "hash"))), lambda e: F.concat(e["name"], F.lit(":"), e["hash"], F.lit("\n")))
        below = entries.groupBy("repo_name", "dir").agg(F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("hash"), F.sum("files").alias("files"))
        below = write_table(below.withColumn("depth", F.lit(depth)), "level")
        found = below if found is None else found.unionByName(below)
    return found.select("repo_name", "dir", "depth", "hash", "files")


def subtree_counts(leaves: DataFrame) -> DataFrame:
    """(repo_name, dir, files): the files at or below each directory, by the prefixes of their paths."""
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return leaves.select("repo_name", F.explode(above).alias("dir")).groupBy("repo_name", "dir").agg(F.count(F.lit(1)).alias("files"))


def tree_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, file_path, change): added, modified or deleted between two snapshots of the same ``key``."""
    before = old.select(key, "file_path", F.col("hash").alias("before"))
    after = new.select(key, "file_path", F.col("hash").alias("after"))
    joined = before.join(after, [key, "file_path"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").otherwise("modified")
    return joined.select(key, "file_path", change.alias("change"))


def _bit_sums(key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            raw = np.frombuffer(bytes.fromhex("".join(batch["hash"])), dtype=np.uint8).reshape(len(batch), BITS // 8)
            signs = np.unpackbits(raw, axis=1).astype(np.int64) * 2 - 1
            names, place = np.unique(batch[key].to_numpy(dtype=object), return_inverse=True)
            sums = np.zeros((len(names), BITS), dtype=np.int64)
            np.add.at(sums, place, signs)
            yield pd.DataFrame({key: names, "sums": list(sums), "files": np.bincount(place)})

    return run


def simhash(leaves: DataFrame, key: str = "repo_name") -> DataFrame:
    """(key, simhash, files): 64 hex digits; a bit is set where more leaf hashes have it set than not.

    A batch of files becomes one vector of 256 sums per key before the shuffle.
    """
    partial = leaves.select(key, "hash").mapInPandas(_bit_sums(key), f"{key} STRING, sums ARRAY<BIGINT>, files BIGINT")
    sums = partial.select(key, "files", F.posexplode("sums").alias("bit", "sum")).groupBy(key, "bit").agg(F.sum("sum").alias("sum"), F.sum("files").alias("files"))
    nibble = F.floor(F.col("bit") / 4)
    digits = sums.groupBy(key, nibble.alias("nibble")).agg(F.sum(F.when(F.col("sum") > 0, F.pow(F.lit(2), 3 - F.col("bit") % 4)).otherwise(0)).cast("int").alias("digit"), F.max("files").alias("files"))
    hexed = F.transform(F.array_sort(F.collect_list(F.struct("nibble", "digit"))), lambda d: F.lower(F.hex(d["digit"])))
    return digits.groupBy(key).agg(F.array_join(hexed, "").alias("simhash"), F.max("files").alias("files"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-digit hashes, by eight words of 32 bits."""
    word = lambda c, i: F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("bigint")
    return sum((F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(8)), F.lit(0)).cast("int")


def similar_collections(hashes: DataFrame, within: str, key: str = "repo_name", most: int = 25) -> DataFrame:
    """(within, key_a, key_b, distance): the pairs of one tenant at a Hamming distance of at most ``most``.

    Pigeonhole on most + 1 slices of the hash: two hashes this near agree in
    at least one slice, so only keys that share a slice meet.
    """
    cuts = [round(i * BITS / (most + 1)) for i in range(most + 2)]
    bits = F.array_join(F.transform(F.split("simhash", ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")
    sliced = hashes.select(within, key, "simhash", bits.alias("bits"))
    slices = F.array(*[F.concat(F.lit(f"{i}:"), F.substring("bits", a + 1, b - a)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
    sliced = sliced.select(within, key, "simhash", F.explode(slices).alias("slice"))
    left = sliced.select(within, F.col(key).alias(f"{key}_a"), F.col("simhash").alias("a"), "slice")
    right = sliced.select(within, F.col(key).alias(f"{key}_b"), F.col("simhash").alias("b"), "slice")
    pairs = left.join(right, [within, "slice"]).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    return pairs.select(within, f"{key}_a", f"{key}_b", hamming(F.col("a"), F.col("b")).alias("distance")).where(F.col("distance") <= most).distinct()


def nearest_collection(hashes: DataFrame, within: str, key: str = "repo_name", most: int = 25) -> DataFrame:
    """(key, nearest, distance) of those that have one near enough; ties go to the first name."""
    pairs = similar_collections(hashes, within, key, most)
    both = pairs.select(F.col(f"{key}_a").alias(key), F.col(f"{key}_b").alias("nearest"), "distance").unionByName(pairs.select(F.col(f"{key}_b").alias(key), F.col(f"{key}_a").alias("nearest"), "distance"))
    first = F.row_number().over(Window.partitionBy(key).orderBy("distance", "nearest"))
    return both.withColumn("nth", first).where("nth = 1").drop("nth")
