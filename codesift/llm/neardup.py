"""Near-duplicate records with small edits: a parity-sketch join.

A record is the set of its runs of ``words`` consecutive words.  For records
A and B with Jaccard similarity of at least t, the symmetric difference is at
most (1 - t) / (1 + t) * (|A| + |B|).

Sketch.  A size band fixes a number of segments; each token falls into one
segment by its hash, and a segment holds the XOR of its tokens' hashes.  One
differing token changes one segment, so the number of differing segments is a
lower bound of the symmetric difference.  A second sketch of 256 bits, of which
each token flips one, bounds it by its Hamming distance; a set of more than 128
tokens, which would fill it, has a wider one of two to four bits a token too.

Pigeonhole join.  With D the largest symmetric difference that any partner
within the band pair may have, at most D segments of a record differ from
those of its partner.  Ordered alike in both records, the first D + 1
non-empty segments therefore hold one that both share.  The order puts rare
segments first, after a table of token counts of fixed size that all records
fill, so boilerplate is hardly ever joined on.  A record takes part in the
segmentation of its own band and of the next larger one; the ratio of bands is
1 / t, hence partners always meet in one of them.  A record of D or fewer
non-empty segments could miss a partner; with three segments per token of the
band's lower end, or 2**24 in bands of fewer than 24 tokens, that is as rare
as equal 64-bit hashes (below 1e-13).

Hot segments.  The count of a segment's rarest token bounds the records that
share the segment.  Segments with a small bound meet in one sort; those that
may be frequent are counted by an aggregation first, so that no task gathers
them, and are cut into blocks.

Candidates are filtered by size and by the Hamming bounds and then verified on
the exact token sets.  A segment of n records has n * n / 2 pairs, so for
segments of more than a few records the sketches go to the segment and pairs
are filtered where they meet: what moves follows the records and not the pairs.

Exact copies (equal token sets) form one class.  A task emits the segments of
a class once, and the join runs between classes, so a third of all rows being
one text adds nothing to it.  Classes are expanded to rows only where the
result asks for rows.

Null texts and texts of fewer than ``least_words`` words take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesift.llm.hashing import flat_word_hashes, mix, window_hashes
from codesift.runtime import cut_lineage, drop_table, write_table

# Counts are exact to the frequency of an average bucket: few buckets let frequent tokens of a large table pass as rare.
TABLE_BITS, PAGE_BITS = 24, 16
SKETCH_WORDS = 4
# Segments of more records than this are joined with the sketches.
FEW = 6
SMALL_BELOW, SMALL_SEGMENTS = 24, 1 << 24
# Weights are twice the binary logarithm of a count: above this a segment may be shared by more than about 2,000 records.
HOT_WEIGHT = 22
RECORDS = "class BIGINT, chunk_id BIGINT, size INT, s0 BIGINT, s1 BIGINT, s2 BIGINT, s3 BIGINT, wide ARRAY<BIGINT>, keys ARRAY<BIGINT>, hot ARRAY<BIGINT>"


class Join:
    """The numbers of one join: words per run, least words, similarity as a fraction."""

    def __init__(self, words: int = 5, least_words: int = 5, numerator: int = 8, denominator: int = 10):
        self.words, self.least, self.num, self.den = words, max(words, least_words), numerator, denominator
        self.t = numerator / denominator
        self.ratio = 1 / self.t

    def most_apart(self, a: float, b: float) -> int:
        """Largest symmetric difference of similar sets of at most these sizes."""
        return math.floor((self.den - self.num) * (a + b) / (self.den + self.num) + 1e-9)

    def band(self, size: int) -> int:
        """Bands are cut with exact integers, so that equal sizes never fall apart."""
        return max(0, math.floor(math.log(max(size, 1)) / math.log(self.ratio) + 1e-9))

    def top(self, band: int) -> int:
        return math.ceil(self.ratio ** (band + 1))


def token_sets(texts: list[str], rule: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token) sorted and distinct over all texts that take part, and the size of each text's set."""
    flat, counts = flat_word_hashes(texts, "word", False)
    ends = np.cumsum(counts)
    windows = window_hashes(flat, rule.words)
    row = np.repeat(np.arange(len(texts)), counts)
    start_row = row[: len(windows)]
    same = np.arange(len(windows)) + rule.words <= ends[start_row] if len(windows) else np.zeros(0, dtype=bool)
    same &= counts[start_row] >= rule.least
    rows, tokens = start_row[same], windows[same]
    order = np.lexsort((tokens, rows))
    rows, tokens = rows[order], tokens[order]
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (tokens[1:] != tokens[:-1])
    rows, tokens = rows[fresh], tokens[fresh]
    return rows, tokens, np.bincount(rows, minlength=len(texts))


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut to a few MB of text, so that memory does not follow the length of texts."""
    for batch in batches:
        texts = batch.column(text_at).to_pylist()
        start, room = 0, 0
        for i, text in enumerate(texts):
            room += len(text)
            if room > 2_000_000:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, room = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def token_counts(texts: DataFrame, rule: Join) -> np.ndarray:
    """How often tokens of each of 2**TABLE_BITS hash buckets occur, over all records: a table of fixed size.

    A task sends the buckets that it saw by pages, as steps from one to the
    next; a page's steps are mostly below 256, so the high bytes compress away.
    """
    step = 1 << PAGE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << TABLE_BITS, dtype=np.uint16)
        for _, part in _blocks(batches, 0):
            _, tokens, _ = token_sets(part, rule)
            seen, n = np.unique(tokens >> np.uint64(64 - TABLE_BITS), return_counts=True)
            seen = seen.astype(np.int64)
            total[seen] = np.minimum(total[seen] + n, 65535)
        for page in range(len(total) // step):
            counts = total[page * step : (page + 1) * step]
            seen = np.flatnonzero(counts)
            if len(seen):
                steps = np.diff(seen, prepend=0).astype(np.uint16)
                parts = ((steps & 255).astype(np.uint8), (steps >> 8).astype(np.uint8), counts[seen])
                yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], ["page", "low", "high", "n"])

    def unite(pieces: pa.Table) -> pa.Table:
        total = np.zeros(step, dtype=np.int64)
        for low, high, n in zip(*[pieces.column(c).to_pylist() for c in ("low", "high", "n")], strict=True):
            seen = np.cumsum(np.frombuffer(low, np.uint8) + 256 * np.frombuffer(high, np.uint8).astype(np.int64))
            total[seen] += np.frombuffer(n, np.uint16)
        weight = np.ceil(np.log2(total + 1) * 2).astype(np.uint8)
        return pa.table({"page": pieces.column("page").slice(0, 1), "weight": pa.array([weight.tobytes()], pa.binary())})

    pages = texts.select("content").mapInArrow(count, "page INT, low BINARY, high BINARY, n BINARY")
    table = np.zeros(1 << TABLE_BITS, dtype=np.uint8)
    for page, weight in pages.groupBy("page").applyInArrow(unite, "page INT, weight BINARY").toLocalIterator():
        table[page * step : (page + 1) * step] = np.frombuffer(weight, np.uint8)
    return table


def segment_keys(tokens: np.ndarray, weight: np.ndarray, rule: Join) -> tuple[np.ndarray, np.ndarray]:
    """The join keys of one record, and those of them that may be frequent: for its band and the next, the first D + 1 segments in the common order."""
    size = len(tokens)
    own = rule.band(size)
    keys, hot = [], []
    for scheme in (own, own + 1):
        partner = min(rule.top(scheme), size * rule.den / rule.num)
        apart = rule.most_apart(size, max(partner, size))
        floor = rule.ratio**scheme
        segments = SMALL_SEGMENTS if floor < SMALL_BELOW else math.ceil(3 * floor)
        place = (mix(tokens ^ np.uint64(0x517CC1B7)) % np.uint64(segments)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        seats = place[order]
        heads = np.flatnonzero(np.diff(seats, prepend=-1))
        parity = np.bitwise_xor.reduceat(mix(tokens[order]), heads)
        rare = np.minimum.reduceat(weight[order], heads)
        made = mix(parity ^ mix(seats[heads].astype(np.uint64) + np.uint64(scheme << 32)))
        first = np.lexsort((made, rare))[: apart + 1]
        busy = rare[first] > HOT_WEIGHT
        keys.append(made[first[~busy]])
        hot.append(made[first[busy]])
    return np.unique(np.concatenate(keys)), np.unique(np.concatenate(hot))


def parity_bits(rows: np.ndarray, tokens: np.ndarray, n: int, width: int = 64 * SKETCH_WORDS) -> np.ndarray:
    """The parity sketch of ``width`` bits, a power of two, of each of ``n`` texts, as words: each token flips one bit.

    A sketch whose halves are joined by XOR is that of half the width.
    """
    bit = (mix(tokens + np.uint64(17)) & np.uint64(width - 1)).astype(np.int64)
    flips = np.bincount(rows * width + bit, minlength=n * width).reshape(n, width) & 1
    return np.packbits(flips.astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def wide_bits(rows: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> list[np.ndarray | None]:
    """The sketch of two to four bits a token of each text whose set would fill the narrow one."""
    found: list[np.ndarray | None] = [None] * len(sizes)
    width = np.where(sizes * 2 > 64 * SKETCH_WORDS, 1 << np.ceil(np.log2(np.maximum(sizes, 1) * 2)).astype(np.int64), 0)
    for each in np.unique(width[width > 0]).tolist():
        chosen = np.flatnonzero(width == each)
        own = width[rows] == each
        for at, words in zip(chosen.tolist(), parity_bits(np.searchsorted(chosen, rows[own]), tokens[own], len(chosen), each), strict=True):
            found[at] = words
    return found


def records(texts: DataFrame, weights, rule: Join) -> DataFrame:
    """One row per text that takes part: its class, size, sketch, and, on the class's first row in a task, its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = weights.value, set()
        for batch, part in _blocks(batches, 1):
            rows, tokens, sizes = token_sets(part, rule)
            taking = np.flatnonzero(sizes)
            if not len(taking):
                continue
            starts = np.concatenate([[0], np.cumsum(sizes)])
            weight = table[(tokens >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
            sums = np.add.reduceat(mix(tokens + np.uint64(5)), starts[taking])
            xors = np.bitwise_xor.reduceat(mix(tokens ^ np.uint64(0xABCDEF)), starts[taking])
            classes = mix(sums ^ mix(xors)).view(np.int64)
            bits = parity_bits(rows, tokens, len(part))[taking]
            wide = wide_bits(rows, tokens, sizes)
            keys, hot = [], []
            for at, label in zip(taking.tolist(), classes.tolist(), strict=True):
                if label in known:
                    keys.append(None)
                    hot.append(None)
                    continue
                known.add(label)
                cut = slice(starts[at], starts[at + 1])
                cold, busy = segment_keys(tokens[cut], weight[cut], rule)
                keys.append(cold.view(np.int64))
                hot.append(busy.view(np.int64))
            ids = batch.column(0).take(pa.array(taking))
            columns = [pa.array(classes), ids, pa.array(sizes[taking].astype(np.int32)), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(SKETCH_WORDS)], pa.array([wide[at] for at in taking.tolist()], type=pa.list_(pa.int64())), pa.array(keys, type=pa.list_(pa.int64())), pa.array(hot, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["class", "chunk_id", "size", "s0", "s1", "s2", "s3", "wide", "keys", "hot"])

    return texts.select("chunk_id", "content").mapInArrow(run, RECORDS)


def pairs_within(rows: DataFrame, key: str, item: str, block: int = 1000) -> DataFrame:
    """(``item``_a, ``item``_b), a < b: the pairs of rows that share ``key``, whose size is column ``n``.

    A key of many rows is cut into blocks, and each pair of blocks is a join
    group of its own, so that no task gets more than two blocks of one key.
    ``rows`` must be distinct in (key, item); other columns come out with the suffixes _a and _b.
    """
    others = [c for c in rows.columns if c not in (key, "n")]
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(item, F.lit(7)), blocks).cast("int")
    placed = rows.withColumn("blocks", blocks).withColumn("own", own)
    left = placed.select(F.col(key), F.col("own").alias("low"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("high"), *[F.col(c).alias(f"{c}_l") for c in others])
    right = placed.select(F.col(key), F.col("own").alias("high"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("low"), *[F.col(c).alias(f"{c}_r") for c in others])
    met = left.join(right, [key, "low", "high"]).where((F.col("low") < F.col("high")) | (F.col(f"{item}_l") < F.col(f"{item}_r")))
    turned = F.col(f"{item}_l") > F.col(f"{item}_r")
    both = [F.when(turned, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{z}") for x, y, z in (("l", "r", "a"), ("r", "l", "b")) for c in others]
    return met.where(F.col(f"{item}_l") != F.col(f"{item}_r")).select(key, *both)


def likely(rows: DataFrame, wanted: DataFrame, key: str, bits: int = 1 << 23) -> DataFrame:
    """The rows whose key may be among those wanted, so that others need not move to a join.

    One bit per hash of a wanted key, in rows of 32,768: a table of ``bits`` / 8
    bytes (1 MB) whatever its input, which goes to every task.
    """
    place = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(bits))
    marked = wanted.select(F.floor(place / 32768).cast("int").alias("page"), F.pmod(place, F.lit(32768)).cast("int").alias("at"))
    pages = marked.groupBy("page").agg(F.expr("bitmap_construct_agg(at)").alias("map"))
    at = F.pmod(F.col("place"), F.lit(32768)).cast("int")
    byte = F.conv(F.hex(F.substring("map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    found = rows.withColumn("place", place).withColumn("page", F.floor(F.col("place") / 32768).cast("int")).join(F.broadcast(pages), "page")
    return found.where(F.getbit(byte, F.pmod(at, F.lit(8))) == 1).select(*rows.columns)


def sketches_apart(a: str, b: str) -> Column:
    """The Hamming distance of two wide sketches at the width of the narrower one; 0, which rules nothing out, where one is missing or the widths are further apart than a factor of two."""

    def half(bits: Column) -> Column:
        words = F.shiftright(F.size(bits), 1)
        return F.zip_with(F.slice(bits, F.lit(1), words), F.slice(bits, words + 1, words), lambda x, y: x.bitwiseXOR(y))

    left, right = F.col(a), F.col(b)
    narrow = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(x)
    each = F.zip_with(narrow(left, right), narrow(right, left), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.when(left.isNotNull() & right.isNotNull(), F.coalesce(F.aggregate(each, F.lit(0), lambda n, x: n + x), F.lit(0))).otherwise(F.lit(0))


class NearDuplicates:
    """The classes of equal token sets and the similar pairs among them."""

    def __init__(self, chunks: DataFrame, rule: Join | None = None):
        rule = rule or Join()
        self.rule = rule
        spark: SparkSession = chunks.sparkSession
        self.texts = chunks.select("chunk_id", "content").where(F.length("content") >= 2 * rule.least - 1)
        weights = spark.sparkContext.broadcast(token_counts(self.texts, rule))
        self.keyed = write_table(records(self.texts, weights, rule), "keyed")
        self.records = write_table(self.keyed.drop("keys", "hot"), "records")
        self._links: DataFrame | None = None

    def members(self) -> DataFrame:
        """(class, chunk_id) of every row that takes part."""
        return self.records.select("class", "chunk_id")

    def _classes(self, *wide: Column) -> DataFrame:
        """One row per class: its smallest row, size and sketch."""
        return self.records.groupBy("class").agg(F.min("chunk_id").alias("rep"), F.max("size").alias("size"), *[F.max(f"s{i}").alias(f"s{i}") for i in range(SKETCH_WORDS)], *wide)

    def _bound(self) -> Column:
        return F.floor((self.rule.den - self.rule.num) * (F.col("size_a") + F.col("size_b")) / (self.rule.den + self.rule.num) + 1e-9)

    def _may_fit(self) -> Column:
        """Whether sizes and narrow sketches of ``_a`` and ``_b`` allow similar sets."""
        hamming = sum(F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(SKETCH_WORDS))
        return (self.rule.num * F.greatest("size_a", "size_b") <= self.rule.den * F.least("size_a", "size_b")) & (hamming <= self._bound())

    def _candidates(self) -> DataFrame:
        """(class_a, class_b): the pairs that share a segment, without those of its segments of many records that sketches rule out."""
        keyed = self.keyed.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "class").repartition("key").distinct()
        # few keys are shared: those that are get written, so that both sides of the join read them and not the sort
        met = write_table(keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1"), "met")
        # frequent ones: copies of a class from several tasks are no partners, and no task gathers a key
        busy = self.keyed.where("size(hot) > 0").select(F.explode("hot").alias("key"), "class").distinct()
        busy = write_table(busy.join(busy.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"), "busy")
        drop_table(self.keyed)
        few = pairs_within(met.where(F.col("n") <= FEW), "key", "class")
        many = met.where(F.col("n") > FEW).unionByName(busy).join(self._classes().drop("rep"), "class")
        both = few.unionByName(pairs_within(many, "key", "class").where(self._may_fit()).select("key", "class_a", "class_b"))
        return both.select("class_a", "class_b").distinct()

    def links(self) -> DataFrame:
        """(class_a, class_b): the pairs of classes whose sets are similar, verified; found once."""
        if self._links is None:
            self._links = write_table(self._verified(), "links")
        return self._links

    def _verified(self) -> DataFrame:
        one = self._classes(F.first("wide").alias("wide"))
        side = lambda z: one.select(*[F.col(c).alias(f"{c}_{z}") for c in one.columns])
        near = self._candidates().join(side("a"), "class_a").join(side("b"), "class_b")
        near = near.where(self._may_fit() & (sketches_apart("wide_a", "wide_b") <= self._bound()))
        near = write_table(near.select("class_a", "class_b", "rep_a", "rep_b"), "near")
        reps = near.select(F.col("class_a").alias("class"), F.col("rep_a").alias("chunk_id")).union(near.select("class_b", "rep_b")).distinct()
        sets = self._sets(likely(self.texts, reps, "chunk_id").join(reps, "chunk_id"))
        side = lambda z: sets.select(F.col("class").alias(f"class_{z}"), F.col("tokens").alias(f"tokens_{z}"))
        both = near.select("class_a", "class_b").join(side("a"), "class_a").join(side("b"), "class_b")
        shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
        union = F.size("tokens_a") + F.size("tokens_b") - shared
        return both.where(self.rule.den * shared >= self.rule.num * union).select("class_a", "class_b")

    def _sets(self, texts: DataFrame) -> DataFrame:
        rule = self.rule

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, part in _blocks(batches, 1):
                _, tokens, sizes = token_sets(part, rule)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(tokens.view(np.int64)))], ["class", "tokens"])

        return texts.select("class", "content").mapInArrow(run, "class BIGINT, tokens ARRAY<BIGINT>")

    def row_pairs(self) -> DataFrame:
        """(chunk_id_a, chunk_id_b), a < b: every pair of rows, copies included."""
        members = self.members()
        sized = members.join(members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "class")
        copies = pairs_within(sized, "class", "chunk_id").select("chunk_id_a", "chunk_id_b")
        links = self.links()
        near = links.join(members.select(F.col("class").alias("class_a"), F.col("chunk_id").alias("x")), "class_a").join(members.select(F.col("class").alias("class_b"), F.col("chunk_id").alias("y")), "class_b")
        return copies.unionByName(near.select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b")))

    def groups(self) -> DataFrame:
        """(chunk_id, group_id, class_size, links): the connected group of each row, named by its smallest class, and its similar rows."""
        links = self.links()
        sizes = self.members().groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("least"))
        both = links.union(links.select("class_b", "class_a")).toDF("class", "other")
        around = both.join(sizes.select(F.col("class").alias("other"), F.col("n").alias("m")), "other").groupBy("class").agg(F.sum("m").alias("near"))
        labels = connected(both)
        per_class = sizes.join(around, "class", "left").join(labels, "class", "left")
        root = F.coalesce("root", "class")
        names = per_class.groupBy(root.alias("root")).agg(F.min("least").alias("group_id"))
        full = per_class.withColumn("root", root).join(names, "root").select("class", "group_id", F.col("n").alias("class_size"), (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("links"))
        return self.members().join(full, "class").select("chunk_id", "group_id", "class_size", "links")


def connected(edges: DataFrame) -> DataFrame:
    """(class, root): the smallest class of each connected component.  ``edges`` (class, other) go both ways.

    Each round takes the smallest label of the neighbours and then the label
    of that label, so chains shrink by powers of two.
    """
    edges = cut_lineage(edges)
    labels = edges.groupBy("class").agg(F.min("other").alias("least")).select("class", F.least("class", "least").alias("root"))
    labels = cut_lineage(labels)
    while True:
        heard = edges.join(labels.select(F.col("class").alias("other"), "root"), "other").groupBy("class").agg(F.min("root").alias("heard"))
        step = labels.join(heard, "class").select("class", F.col("root").alias("before"), F.least("root", "heard").alias("root"))
        jump = step.select(F.col("class").alias("root"), F.col("root").alias("next"))
        after = cut_lineage(step.join(jump, "root", "left").select("class", "before", F.least("root", F.coalesce("next", "root")).alias("root")))
        if after.where("before <> root").isEmpty():
            return after.select("class", "root")
        labels = after.select("class", "root")
