"""Evaluation texts leaking into training text.

The items' normalised word n-grams are hashed and broadcast as a sorted
array; each partition of the corpus scans its token windows against it.  A hit
is verified word by word against the items, so a hash collision cannot report
a leak.  Items are stated queries: their n-grams and characters are counted
first, and beyond ``max_broadcast`` n-grams (24 bytes each, besides the texts)
or 16 times as many characters the windows are joined instead of broadcast.
Both ways give the same rows.

A word is a maximal run of ASCII letters and digits; letter case and
invisible characters are ignored.  Null or shorter texts hold no window.
Documents are told apart by ``doc_id`` and text: rows that agree in both are
reported once and cleaned alike.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesift.llm.hashing import word_hashes, window_hashes

# Characters that do not show: soft hyphen, zero-width marks, direction marks, joiners.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
STRIP = str.maketrans("", "", INVISIBLE)
SEEN = re.compile(f"[{INVISIBLE}]")
WORD = re.compile(r"[A-Za-z0-9]+")
HITS = "doc_id BIGINT, item_id BIGINT, first_word INT, last_word INT"
CLEANED = "doc_id BIGINT, text STRING, removed_spans INT, removed_chars INT"


def normal(text: str) -> str:
    return text.translate(STRIP) if SEEN.search(text) else text


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(normal(text))]


class ItemIndex:
    """The hashes of the items' n-grams in order, the place of each, and the texts for the check of a hit."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.ids, self.texts = n, [i for i, _ in items], [t or "" for _, t in items]
        hashes, _ = word_hashes([normal(t) for t in self.texts], keep="alnum", fold=True)
        grams = [window_hashes(h, n) for h in hashes]
        flat = np.concatenate([*grams, np.empty(0, dtype=np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.item = np.repeat(np.arange(len(items), dtype=np.int64), [len(g) for g in grams])[order]
        self.at = np.concatenate([*[np.arange(len(g), dtype=np.int64) for g in grams], np.empty(0, dtype=np.int64)])[order]

    def words(self, item: int) -> list[str]:
        return _item_words(self.texts[item])

    def hits(self, windows: np.ndarray) -> np.ndarray:
        if not len(self.hashes) or not len(windows):
            return np.empty(0, dtype=np.int64)
        at = np.searchsorted(self.hashes, windows)
        at[at == len(self.hashes)] = 0
        return np.flatnonzero(self.hashes[at] == windows)

    def spans(self, text: str, windows: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, last word) of the verified passages, joined where they run on."""
        found = self.hits(windows)
        if not len(found):
            return []
        words = words_of(text)
        covered: dict[int, list[list[int]]] = defaultdict(list)
        low, high = np.searchsorted(self.hashes, windows[found]), np.searchsorted(self.hashes, windows[found], side="right")
        for start, first, last in zip(found.tolist(), low.tolist(), high.tolist(), strict=True):
            window = words[start : start + self.n]
            for place in range(first, last):
                own, at = int(self.item[place]), int(self.at[place])
                if self.words(own)[at : at + self.n] == window:
                    runs = covered[self.ids[own]]
                    if runs and start <= runs[-1][1] + 1:
                        runs[-1][1] = max(runs[-1][1], start + self.n - 1)
                    else:
                        runs.append([start, start + self.n - 1])
        return [(item, a, b) for item, runs in covered.items() for a, b in runs]


@lru_cache(maxsize=4096)
def _item_words(text: str) -> list[str]:
    return words_of(text)


def _small(items: DataFrame, n: int, max_broadcast: int) -> bool:
    """Whether the items' n-grams and texts are few enough to go to every worker."""
    plain = F.translate("text", INVISIBLE, "")
    size = items.select(F.sum(F.greatest(F.regexp_count(plain, F.lit("[A-Za-z0-9]+")) - (n - 1), F.lit(0))), F.sum(F.length("text"))).first()
    return (size[0] or 0) <= max_broadcast and (size[1] or 0) <= 16 * max_broadcast


def _index(items: DataFrame, n: int):
    return items.sparkSession.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in items.select("item_id", "text").where("text IS NOT NULL").collect()], n))


def _scan(index, n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = index.value
        for batch in batches:
            out = []
            texts = [normal(t) for t in batch["text"]]
            hashes, _ = word_hashes(texts, keep="alnum", fold=True)
            for doc, text, own in zip(batch["doc_id"], texts, hashes, strict=True):
                out += [(doc, item, a, b) for item, a, b in items.spans(text, window_hashes(own, n))]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "first_word", "last_word"])

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, n: int = 12, max_broadcast: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, first_word, last_word): every passage of at least ``n`` words that a document shares with an item.

    A passage is reported per maximal run of shared windows in the document.
    """
    texts = documents.select("doc_id", "text").where("text IS NOT NULL")
    if not _small(items, n, max_broadcast):
        return _joined_passages(texts, items, n).select("doc_id", "item_id", "first_word", "last_word").distinct()
    return texts.mapInPandas(_scan(_index(items, n), n), HITS).distinct()


def _windows(key: str, n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [normal(t) for t in batch["text"]]
            hashes, _ = word_hashes(texts, keep="alnum", fold=True)
            for own_key, digest, text, own in zip(batch[key], batch["digest"], texts, hashes, strict=True):
                grams = window_hashes(own, n)
                words = words_of(text)
                if len(grams):
                    joined = pd.Series([" ".join(words[i : i + n]) for i in range(len(grams))], dtype=object)
                    yield pd.DataFrame({key: np.full(len(grams), own_key), "digest": pd.Series([digest] * len(grams), dtype=object), "gram": grams.view(np.int64), "words": joined, "at": np.arange(len(grams), dtype=np.int32)})

    return run


def _digest() -> Column:
    return F.sha2(F.col("text").cast("binary"), 256)


def _joined_passages(texts: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(doc_id, digest, item_id, first_word, last_word): the same by a join on the window, for item sets too large to broadcast."""
    grams = "digest STRING, gram BIGINT, words STRING, at INT"
    left = texts.select("doc_id", "text", _digest().alias("digest")).mapInPandas(_windows("doc_id", n), f"doc_id BIGINT, {grams}")
    right = items.where("text IS NOT NULL").select("item_id", "text", F.lit("").alias("digest")).mapInPandas(_windows("item_id", n), f"item_id BIGINT, {grams}").select("item_id", "gram", "words").distinct()
    hits = left.join(right, ["gram", "words"]).select("doc_id", "digest", "item_id", "at").distinct()
    order = Window.partitionBy("doc_id", "digest", "item_id").orderBy("at")
    runs = hits.withColumn("run", F.sum(F.when(F.col("at") - F.lag("at").over(order) <= n, 0).otherwise(1)).over(order))
    return runs.groupBy("doc_id", "digest", "item_id", "run").agg(F.min("at").alias("first_word"), (F.max("at") + n - 1).cast("int").alias("last_word")).drop("run")


def leaked_items(documents: DataFrame, items: DataFrame, n: int = 12) -> DataFrame:
    """(doc_id, item_id), once each."""
    return leaked_passages(documents, items, n).select("doc_id", "item_id").distinct()


def _without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(text less the words of the spans, number of joined spans, characters removed)."""
    text, merged = normal(text), []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    marks = [m.span() for m in WORD.finditer(text)]
    left, at = [], 0
    for a, b in merged:
        left.append(text[at : marks[a][0]])
        at = marks[b][1]
    clean = "".join([*left, text[at:]])
    return clean, len(merged), len(text) - len(clean)


def _remove(index, n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = index.value
        for batch in batches:
            out = []
            texts = [normal(t) for t in batch["text"]]
            hashes, _ = word_hashes(texts, keep="alnum", fold=True)
            for doc, raw, text, own in zip(batch["doc_id"], batch["text"], texts, hashes, strict=True):
                spans = [(a, b) for _, a, b in items.spans(text, window_hashes(own, n))]
                out.append((doc, *_without(raw, spans)) if spans else (doc, raw, 0, 0))
            yield pd.DataFrame(out, columns=["doc_id", "text", "removed_spans", "removed_chars"])

    return run


def _remove_listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(doc, *_without(text, [(s["first_word"], s["last_word"]) for s in spans])) if spans is not None and len(spans) else (doc, text, 0, 0) for doc, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True)]
        yield pd.DataFrame(out, columns=["doc_id", "text", "removed_spans", "removed_chars"])


def without_leaks(documents: DataFrame, items: DataFrame, n: int = 12, drop_documents: bool = False, max_broadcast: int = 2_000_000) -> DataFrame:
    """The corpus with leaked spans cut out, or, with ``drop_documents``, without the documents that hold one.

    Documents with null text come out unchanged.  A ``doc_id`` that comes with
    several texts is cleaned text by text; dropped are all its rows.
    """
    if drop_documents:
        return documents.join(leaked_passages(documents, items, n, max_broadcast).select("doc_id").distinct(), "doc_id", "left_anti")
    texts = documents.select("doc_id", "text").where("text IS NOT NULL")
    if _small(items, n, max_broadcast):
        cleaned = texts.mapInPandas(_remove(_index(items, n), n), CLEANED)
    else:
        spans = _joined_passages(texts, items, n).groupBy(F.col("doc_id").alias("doc"), F.col("digest").alias("own")).agg(F.collect_set(F.struct("first_word", "last_word")).alias("spans"))
        marked = texts.withColumn("digest", _digest())
        joined = marked.join(spans, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("digest") == F.col("own")), "left")
        cleaned = joined.select("doc_id", "text", "spans").mapInPandas(_remove_listed, CLEANED)
    empty = documents.where("text IS NULL").select("doc_id", "text", F.lit(0).alias("removed_spans"), F.lit(0).alias("removed_chars"))
    return cleaned.unionByName(empty)
