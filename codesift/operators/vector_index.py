"""An index over vectors: cells around centroids, searched cell by cell, with exact scores.

The centroids are fitted on a bounded sample (``sample`` vectors, chosen by a
hash of their ids); every vector is then put into the cell of its nearest
centroid.  A query looks into its ``probes`` nearest cells and scores all
vectors there, so scores are exact and only a neighbour in another cell can be
missed.  Cells are cut into blocks of vectors and of queries, so neither a cell
that holds a third of all vectors nor many queries for one cell gather in a
task, and nothing but the centroids goes through the driver.

Null, empty and zero vectors take no part; equal scores (to six places) are
ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesift.functions.vectors import norm

PLACED = "vec_id BIGINT, embedding ARRAY<FLOAT>, cell INT"


def usable(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).where((F.size("embedding") > 0) & (norm(F.col("embedding")) > 0))


def _unit(rows: pd.Series) -> np.ndarray:
    matrix = np.stack(rows.to_numpy()).astype(np.float64)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def fit_centroids(vectors: DataFrame, cells: int = 64, sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means on at most ``sample`` vectors."""
    picked = usable(vectors).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if not len(picked):
        return np.zeros((0, 0))
    rows = _unit(picked["embedding"])
    start = np.random.default_rng(7).choice(len(rows), min(cells, len(rows)), replace=False)
    centres = rows[np.sort(start)]
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        sizes = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(sizes > 0, sums / np.where(sizes > 0, sizes, 1), centres)
    return centres


def into_cells(vectors: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """(vec_id, embedding, cell): each vector in its ``probes`` nearest cells."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            near = np.argsort(-(_unit(batch["embedding"]) @ sent.value.T), axis=1, kind="stable")[:, :probes]
            yield batch.loc[batch.index.repeat(near.shape[1])].assign(cell=near.ravel().astype(np.int32))

    return usable(vectors).mapInPandas(run, PLACED)


def search(vectors: DataFrame, queries: DataFrame, k: int, centres: np.ndarray, probes: int = 12, block: int = 20_000) -> DataFrame:
    """(query_id, vec_id, score, place): the ``k`` best of the cells that each query looks into, itself left out."""
    empty = "query_id BIGINT, vec_id BIGINT, score DOUBLE"
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], empty + ", place BIGINT")
    placed, asked = into_cells(vectors, centres), into_cells(queries, centres, probes)
    sized = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = F.broadcast(sized(placed, "blocks").join(sized(asked, "groups"), "cell"))  # a row per cell
    left = placed.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "vec_id", "embedding")
    right = asked.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int").alias("group"), "vec_id", "embedding")

    def score(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        matrix, ids, out = _unit(rows["embedding"]), rows["vec_id"].to_numpy(), []
        asking, names = _unit(wanted["embedding"]), wanted["vec_id"].to_numpy()
        for at in range(0, len(names), 256):
            for name, own in zip(names[at : at + 256], np.round(asking[at : at + 256] @ matrix.T, 6), strict=True):
                best = np.lexsort((ids, -own))[: k + 1]
                out.append(pd.DataFrame({"query_id": name, "vec_id": ids[best], "score": own[best]}))
        return pd.concat(out)

    keys = ["cell", "part", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, empty).where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("place", place.cast("bigint")).where(F.col("place") <= k)
