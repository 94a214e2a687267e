"""Filling fixed-capacity containers: harmonic packing of documents measured in tokens.

A document of n tokens belongs to class k = floor(capacity / n): k documents of
the class always fit into one container, so each worker fills the containers
of a class with a fixed count, without looking at other workers.  The last
class, of documents below capacity / ``classes``, is filled next-fit.  What
single-document and two-document containers leave open is topped up within the
worker with documents of the last classes, largest first, before these get
containers of their own.

Only texts above the capacity are split, at token boundaries; all their pieces
but the last fill a container alone, the last is packed like a document.

A worker packs a bounded block of documents: blocks are ranges of a hash of
the document, so no block grows with the corpus, whatever class or source is
frequent, and each leaves at most one open container per class.

Null and empty texts have no tokens and take no container.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("CODESIFT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
SIZES = "doc_id BIGINT, tokens INT"
PLACED = "spec_id INT, container STRING, doc_id BIGINT, piece INT, first_token INT, tokens INT"

# Fixed value: the pre-tokenization pattern of the public byte-level BPE vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def ship(spark: SparkSession, path: str) -> str:
    """Hand the rank file on to the workers with the job; its name there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encoder(name: str):
    """The tokenizer of a shipped rank file: a function from whole texts to numbers of tokens."""
    import tiktoken
    from pyspark import SparkFiles

    with open(SparkFiles.get(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def token_sizes(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every document with text."""
    name = ship(documents.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = encoder(name)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": pd.Series([count(t) for t in batch["text"]], dtype="int32")})

    return documents.select("doc_id", "text").where(F.length("text") > 0).mapInPandas(run, SIZES)


def pack(sizes: list[tuple[int, int]], capacity: int, classes: int = 24) -> list[list[tuple[int, int, int, int]]]:
    """Containers of (document, piece, first token, tokens) for (document, tokens); deterministic."""
    full: list[list[tuple[int, int, int, int]]] = []
    items: list[tuple[int, int, int, int]] = []
    for doc, n in sorted(sizes):
        pieces = -(-n // capacity)
        for i in range(pieces - 1):
            full.append([(doc, i, i * capacity, capacity)])
        if n:
            items.append((doc, pieces - 1, (pieces - 1) * capacity, n - (pieces - 1) * capacity))
    by_class: dict[int, list[tuple[int, int, int, int]]] = {}
    for item in items:
        by_class.setdefault(min(classes, capacity // item[3]), []).append(item)
    out = list(full)
    small = sorted(((x[3], x) for k, group in by_class.items() if k >= 3 for x in group), key=lambda p: (p[0], p[1]))
    for k in (1, 2):
        group = sorted(by_class.get(k, ()), key=lambda x: (-x[3], x[0]))
        for at in range(0, len(group), k):
            bin_ = group[at : at + k]
            room = capacity - sum(x[3] for x in bin_)
            while small:
                i = bisect_right(small, room, key=lambda p: p[0]) - 1
                if i < 0:
                    break
                taken = small.pop(i)
                bin_.append(taken[1])
                room -= taken[0]
            out.append(bin_)
    rest: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, item in small:
        rest.setdefault(min(classes, capacity // n), []).append(item)
    for k in sorted(rest):
        if k < classes:
            group = rest[k]
            out += [group[at : at + k] for at in range(0, len(group), k)]
        else:
            bin_, room = [], capacity
            for item in rest[k]:
                if item[3] > room:
                    out.append(bin_)
                    bin_, room = [], capacity
                bin_.append(item)
                room -= item[3]
            if bin_:
                out.append(bin_)
    return _refit(out, capacity, len(full))


def _refit(bins: list[list[tuple[int, int, int, int]]], capacity: int, kept: int) -> list[list[tuple[int, int, int, int]]]:
    """Containers that fit whole into what another leaves open are joined to it, fullest first."""
    head, tail = bins[:kept], bins[kept:]
    load = sorted(((sum(x[3] for x in b), i) for i, b in enumerate(tail)), reverse=True)
    open_: list[tuple[int, int]] = []
    for used, i in load:
        at = bisect_right(open_, (capacity - used, len(tail)))
        # the fullest container that still has room for this one whole
        room = capacity - used
        fit = next((j for j in range(at - 1, -1, -1) if open_[j][0] <= room), None)
        if fit is None:
            insort(open_, (used, i))
        else:
            other_used, other = open_.pop(fit)
            tail[other] += tail[i]
            tail[i] = []
            insort(open_, (other_used + used, other))
    return head + [b for b in tail if b]


def blocks_for(total: int, block: int) -> int:
    return max(1, -(-total // block))


def pack_documents(documents: DataFrame, specs: DataFrame, path: str = TOKENIZER, block: int = 20_000) -> DataFrame:
    """(spec_id, container, doc_id, piece, first_token, tokens): every token of every text in one container of each size.

    Every size in ``specs`` is served; they are arguments of the call and go
    with the task, each block is packed once per size.  Of several sizes under
    one ``spec_id`` the smallest holds.  A repeated doc_id is packed as often
    as it comes.
    """
    sizes = [(r[0], r[1]) for r in specs.where("capacity_tokens > 0 AND spec_id IS NOT NULL").groupBy("spec_id").agg(F.min("capacity_tokens")).toLocalIterator()]
    sizes.sort()
    measured = token_sizes(documents, path)
    parts = blocks_for(documents.count(), block)
    # an id that comes again and again is spread like any other
    spread = measured.withColumn("place", F.monotonically_increasing_id()).repartition(parts, F.xxhash64("doc_id", "place")).drop("place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        docs: list[tuple[int, int]] = []
        for batch in batches:
            docs += zip(batch["doc_id"].tolist(), batch["tokens"].tolist(), strict=True)
        for spec, capacity in sizes:
            rows = [(spec, f"{spec}-{place}-{i}", *item) for i, bin_ in enumerate(pack(docs, capacity)) for item in bin_]
            yield pd.DataFrame(rows, columns=["spec_id", "container", "doc_id", "piece", "first_token", "tokens"])

    return spread.mapInPandas(run, PLACED)


def fill_rates(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers, tokens and share of space used per size."""
    sums = packed.groupBy("spec_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    sizes = specs.where("capacity_tokens > 0").groupBy("spec_id").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    return sums.join(sizes, "spec_id").withColumn("filled", F.round(F.col("tokens") / F.col("containers") / F.col("capacity_tokens"), 4))
