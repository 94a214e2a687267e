"""Splitting oversized items at natural boundaries.

Every line start of an item is a possible cut with a strength that tells how
natural a cut there is.  A sparse table answers "which is the strongest cut of
this window, the rightmost among equals" in constant time, so an item of n
lines costs O(n log n) once and O(1) per piece.  After a cut the next piece
steps back by the stated number of lines.

Defined results: a null or empty text, an unknown type and a text within the
limit give no pieces; a limit below one gives none either; of several limits
of a type the smallest holds.  A line longer than
the limit is cut after blanks or punctuation, or else hard at the limit.  A
piece repeats fewer lines than stated only where the repeated lines and the
next part would not fit within the limit; a cut inside a line repeats nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Lines that open a definition, or close a block, in the languages of the collection.
OPENS = re.compile(r"\s*(?:@|#\[|(?:pub(?:\([a-z]+\))?|export|default|async|public|private|static|abstract)\b.*|(?:def|class|func|function|fn|impl|struct|enum|trait|type|interface|mod|package|const|let|var)\b)")
OPENS_INSIDE = re.compile(r"\s*(?:if|for|while|match|switch|select|try|with|case|loop|return|go|defer)\b")
CLOSES = re.compile(r"\s*[)\]}]+[;,]?\s*$")
BREAKS = re.compile(r"[\s;,{}()\[\]]")

PIECES = "piece_index INT, piece_count INT, content STRING, first_line INT, last_line INT, repeated_lines INT"


def strengths(lines: list[str]) -> np.ndarray:
    """Strength of a cut before each line: blank line before, shallow indent and a definition ahead make it strong."""
    out = np.zeros(len(lines), dtype=np.int64)
    blank_before, closed_before = False, False
    for i, line in enumerate(lines):
        body = line.strip()
        if not body:
            out[i] = 3
            blank_before = True
            continue
        indent = len(line) - len(line.lstrip())
        value = 10 - min(8, indent // 2)
        if blank_before:
            value += 30
        if OPENS.match(line):
            value += 24
        elif OPENS_INSIDE.match(line):
            value += 6
        if closed_before:
            value += 8
        if CLOSES.match(line):
            value = 1
        out[i] = value
        blank_before, closed_before = False, bool(CLOSES.match(line))
    return out


class StrongestCut:
    """Sparse table over strengths; the rightmost of equals wins."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        level = values * (n + 1) + np.arange(n)
        self.n, self.levels = n, [level]
        width = 1
        while 2 * width <= n:
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def best(self, low: int, high: int) -> int:
        """Index of the strongest in low..high, both included."""
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[low], level[high - (1 << k) + 1]) % (self.n + 1))


def cut_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, repeated lines) of each piece, as offsets into ``text``."""
    size = len(text)
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    starts.pop()
    force = strengths(lines)
    at, value = starts[1:], force[1:].tolist()
    if any(len(line) > limit for line in lines):
        inner = [(starts[i] + m.end(), 0) for i, line in enumerate(lines) if len(line) > limit for m in BREAKS.finditer(line) if m.end() < len(line)]
        both = sorted([*zip(at, value, strict=True), *inner])
        at, value = [p for p, _ in both], [v for _, v in both]
    table = StrongestCut(np.array(value, dtype=np.int64)) if at else None
    out: list[tuple[int, int, int]] = []
    start, done, repeated = 0, 0, 0
    while size - start > limit:
        # the window: at least half full, later than what is done; wider if it holds no cut
        high = bisect_right(at, start + limit) - 1
        low = bisect_left(at, max(done + 1, start + limit // 2))
        if low > high:
            low = bisect_left(at, done + 1)
        cut = at[table.best(low, high)] if low <= high else start + limit
        out.append((start, cut, repeated))
        done, start, repeated = cut, cut, 0
        line = bisect_left(starts, cut)
        if overlap > 0 and line < len(starts) and starts[line] == cut:
            # as many of the stated lines as leave room for the next cut
            follow = bisect_right(at, cut)
            need = at[follow] if follow < len(at) else size
            floor = bisect_right(starts, out[-1][0])
            for back in range(min(overlap, line - floor + (out[-1][0] == starts[floor - 1])), 0, -1):
                if need - starts[line - back] <= limit and starts[line - back] > out[-1][0]:
                    start, repeated = starts[line - back], back
                    break
    out.append((start, size, repeated))
    return out


def _cut(carried: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, rows = [], []
            for i, (text, limit, overlap) in enumerate(zip(batch["content"], batch["max_chars"], batch["overlap_lines"], strict=True)):
                pieces = cut_text(text, int(limit), int(overlap))
                before, first = 0, 0
                for n, (start, end, repeated) in enumerate(pieces):
                    # pieces begin one after the other, so each line end is counted once, and once more where it is repeated
                    first += text.count("\n", before, start)
                    before = start
                    at.append(i)
                    rows.append((n, len(pieces), text[start:end], first, first + text.count("\n", start, end - 1), repeated))
            own = pd.DataFrame(rows, columns=["piece_index", "piece_count", "content", "first_line", "last_line", "repeated_lines"])
            yield pd.concat([batch[carried].take(at).reset_index(drop=True), own], axis=1)

    return run


def oversized(chunks: DataFrame, limits: DataFrame, *carried: str) -> DataFrame:
    """The items above their type's limit: (carried, content, max_chars, overlap_lines).

    ``limits`` has one row per type; it is joined by the planner, which broadcasts it when small.
    """
    kind = F.lower(F.trim(F.regexp_replace("chunk_type", r"\s+", " ")))
    sizes = limits.select(F.lower(F.trim("chunk_type")).alias("kind"), "max_chars", F.coalesce("overlap_lines", F.lit(0)).alias("overlap_lines")).where("max_chars > 0 AND kind IS NOT NULL")
    sizes = sizes.groupBy("kind").agg(F.min("max_chars").alias("max_chars"), F.min_by("overlap_lines", "max_chars").alias("overlap_lines"))
    large = chunks.select(*carried, "content", kind.alias("kind")).join(sizes, "kind").where(F.length("content") > F.col("max_chars"))
    return large.select(*carried, "content", "max_chars", "overlap_lines")


def pieces_of(large: DataFrame) -> DataFrame:
    """The pieces of each item, beside the columns it carries; lines are counted from 0 within the item."""
    carried = [f for f in large.schema if f.name not in ("content", "max_chars", "overlap_lines")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in carried), PIECES])
    return large.mapInPandas(_cut([f.name for f in carried]), schema)


def cut_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every item above its type's limit by ``chunk_id``.  The length test runs before anything leaves the JVM."""
    return pieces_of(oversized(chunks, limits, "chunk_id"))


def first_lines(chunks: DataFrame, block: int = 512) -> DataFrame:
    """(repo_name, file_path, chunk_index, base): the line of its file on which each item begins.

    A file is its items in order with one blank line between.  The running
    sum goes over blocks of items first, so that no task sorts more than a
    block or the block totals of one file.
    """
    height = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 2
    parts = chunks.groupBy("repo_name", "file_path", "chunk_index").agg(F.max(height).cast("bigint").alias("height")).withColumn("block", F.floor(F.col("chunk_index") / block))
    blocks = parts.groupBy("repo_name", "file_path", "block").agg(F.sum("height").alias("total"))
    file = Window.partitionBy("repo_name", "file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("before", F.coalesce(F.sum("total").over(file), F.lit(0))).drop("total")
    inside = Window.partitionBy("repo_name", "file_path", "block").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("local", F.coalesce(F.sum("height").over(inside), F.lit(0)))
    before = before.toDF("r", "p", "b", "before")
    same = F.col("repo_name").eqNullSafe(F.col("r")) & F.col("file_path").eqNullSafe(F.col("p")) & F.col("block").eqNullSafe(F.col("b"))
    return local.join(before, same).select("repo_name", "file_path", "chunk_index", (F.col("before") + F.col("local") + 1).alias("base"))


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces with ``start_line`` and ``end_line`` in the file, whatever the stored lines say.

    Only the text of oversized items moves, once, to meet the line its item
    begins on; rows without a ``chunk_index`` have no place in their file and
    get no lines.
    """
    large = oversized(chunks, limits, "chunk_id", "repo_name", "file_path", "chunk_type", "chunk_index")
    lines = first_lines(chunks).select(F.col("repo_name").alias("r"), F.col("file_path").alias("p"), F.col("chunk_index").alias("c"), F.col("base").cast("int").alias("base"))
    placed = large.join(lines, F.col("repo_name").eqNullSafe(F.col("r")) & F.col("file_path").eqNullSafe(F.col("p")) & (F.col("chunk_index") == F.col("c")), "left").drop("r", "p", "c", "chunk_index")
    return pieces_of(placed).select(
        "chunk_id", "repo_name", "file_path", "chunk_type", "piece_index", "piece_count", "content",
        (F.col("base") + F.col("first_line")).alias("start_line"), (F.col("base") + F.col("last_line")).alias("end_line"), "repeated_lines",
    )


def rebuilt(pieces: DataFrame) -> DataFrame:
    """(chunk_id, pieces, longest, text_hash): the items put together again from their pieces, less the lines they repeat."""
    fresh = F.when(F.col("repeated_lines") == 0, F.col("content")).otherwise(F.array_join(F.slice(F.split("content", "\n", -1), F.col("repeated_lines") + 1, F.length("content") + 1), "\n"))
    parts = pieces.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece_index", fresh.alias("text")))).alias("parts"), F.max(F.length("content")).alias("longest"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return parts.select("chunk_id", F.size("parts").alias("pieces"), "longest", F.sha2(text.cast("binary"), 256).alias("text_hash"))
