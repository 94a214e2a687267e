"""Source files that do not parse.

Each chunk becomes a lexer-state map: for every state in which it may begin,
the state in which it ends and a bracket summary (closers that were opened
before, openers left open); a chunk of Python also gets an indentation
summary.  Maps of neighbours compose, and composition is associative, so a
file is reduced block by block without moving its text.  A file whose map from
``code`` does not end in ``code`` with nothing open, or runs into something no
lexer accepts, is malformed; in JavaScript and TypeScript, where a cut may lie
within a template or an element, the whole file tells.  Balanced files are
parsed by local grammars (Python's is the parser of this interpreter): a chunk
that is a run of statements by itself is accepted in place, in Python at the
column where its first statement stands; only files with chunks that are not
(methods cut off a class in braces, literals cut in the middle) are put
together, by a grouping that the plan itself demands, and parsed as a whole.

Defined results: null content counts as empty; rows of one file with equal
``chunk_index`` are one chunk; an empty file is well-formed, but in Go, where
the package clause is required; rows of a null repository are files of one
unnamed repository; files of other extensions and rows without a path take no
part.  The text of one file, where it has to be parsed as a whole, is one row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm import grammars, indents
from codesift.llm.lexing import CODE, Malformed, bracket_summary, join_brackets, leave, lex
from codesift.runtime import cut_lineage

#: Their maps have no states within ``${}`` and JSX: a map that fails may be due to a cut there.
CUT_ANYWHERE = ("js", "jsx", "ts", "tsx")
LANGUAGES = ("py", "js", "jsx", "ts", "tsx", "go", "rs")
BLOCK = 256
#: Calls within each other that the grammars may take: tens of thousands of brackets, beyond what compilers of these languages take.
DEEPEST = 200_000
DEAD = "dead"

_STEP = "STRUCT<entry: STRING, exit: STRING, closers: STRING, openers: STRING>"
_REST = f"whole BOOLEAN, asks ARRAY<INT>, levels ARRAY<INT>, steps ARRAY<{_STEP}>"
CHUNK = f"repo_name STRING, file_path STRING, lang STRING, chunk_index INT, {_REST}"
PART = f"repo_name STRING, file_path STRING, lang STRING, block INT, {_REST}"


def states_of(lang: str, text: str) -> list[str]:
    """The states other than ``code`` in which a chunk of the language may begin."""
    if lang == "py":
        return list(indents.STATES)
    if lang == "go":
        return ["comment", "goraw"]
    if lang == "rs":
        return ["comment", "string", 'raw"', 'raw"#', 'raw"##', 'raw"###']
    return ["comment", "template"]


def well_formed(text: str, lang: str) -> bool:
    """Whether a whole file parses.  What is nested deeper than ``DEEPEST`` calls no compiler takes: it does not."""
    if lang == "py":
        return indents.parses(text)
    with _deep():
        try:
            tokens = lex(text, lang)
            if tokens.state != CODE or bracket_summary(tokens.kinds, tokens.match) != ("", ""):
                return False
            grammars.check(tokens, lang, True)
        except (Malformed, RecursionError):
            return False
    return True


@contextmanager
def _deep():
    """Python calls take no stack of the machine, so a fixed number of them is allowed, whatever the worker is set to."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(DEEPEST)
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def _python_map(text: str) -> tuple[bool, list[tuple[str, str, str, str]], tuple[list[int], list[int]]]:
    summary = indents.statements(text)
    steps = []
    for state in (CODE, *indents.STATES):
        if summary is not None:
            # statements; within a string that was opened before, the whole file tells
            exit_ = CODE if state == CODE else indents.UNSURE if state[-3:] in text else state
            steps.append((state, exit_, "", ""))
            continue
        try:
            if text.endswith("\\"):
                raise indents.Lost
            end, brackets = indents.scan(text, state)
            steps.append((state, end, *bracket_summary(brackets)))
        except indents.Lost:
            steps.append((state, indents.UNSURE, "", ""))
        except Malformed:
            steps.append((state, DEAD, "", ""))
    return summary is not None, steps, summary or ([], [])


def chunk_map(text: str, lang: str, first: bool) -> tuple[bool, list[tuple[str, str, str, str]], tuple[list[int], list[int]]]:
    """(whether the chunk stands by itself, its map, its indentation summary)."""
    if lang == "py":
        return _python_map(text)
    with _deep():
        return _brace_map(text, lang, first)


def _brace_map(text: str, lang: str, first: bool) -> tuple[bool, list[tuple[str, str, str, str]], tuple[list[int], list[int]]]:
    steps, stands = [], False
    try:
        tokens = lex(text, lang)
        closers, openers = bracket_summary(tokens.kinds, tokens.match)
        steps.append((CODE, tokens.state, closers, openers))
        if tokens.state == CODE and not closers and not openers:
            try:
                grammars.check(tokens, lang, first)
                stands = True
            except (Malformed, RecursionError):
                pass
    except (Malformed, RecursionError):
        steps.append((CODE, DEAD, "", ""))
    for state in states_of(lang, text):
        try:
            if leave(text, state) < 0:
                steps.append((state, state, "", ""))
                continue
            tokens = lex(text, lang, state)
            steps.append((state, tokens.state, *bracket_summary(tokens.kinds)))
        except (Malformed, RecursionError):
            steps.append((state, DEAD, "", ""))
    return stands, steps, ([], [])


def compose(one: dict, other: dict) -> dict:
    """The map of two texts in a row: entry -> (exit, closers, openers)."""
    out = {}
    for entry, (middle, closers, openers) in one.items():
        if middle in (DEAD, indents.UNSURE):
            out[entry] = (middle, "", "")
            continue
        after = other.get(middle)
        if after is None:
            # a raw string with more marks than the map lists: it holds on
            after = (middle, "", "")
        if after[0] in (DEAD, indents.UNSURE):
            out[entry] = (after[0], "", "")
            continue
        try:
            out[entry] = (after[0], *join_brackets((closers, openers), after[1:]))
        except Malformed:
            out[entry] = (DEAD, "", "")
    return out


def _map_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for repo, path, lang, index, text in zip(batch["repo_name"], batch["file_path"], batch["lang"], batch["chunk_index"], batch["content"], strict=True):
            stands, steps, (asks, levels) = chunk_map(text, lang, index == 0)
            rows.append((repo, path, lang, index, stands, asks, levels, [dict(zip(("entry", "exit", "closers", "openers"), s, strict=True)) for s in steps]))
        yield pd.DataFrame(rows, columns=["repo_name", "file_path", "lang", "chunk_index", "whole", "asks", "levels", "steps"])


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for repo, path, lang, block, parts in zip(batch["repo_name"], batch["file_path"], batch["lang"], batch["block"], batch["parts"], strict=True):
            total, summary = None, ([], [])
            for part in sorted(parts, key=lambda p: p["at"]):
                summary = indents.join_indents(summary, (list(part["asks"]), list(part["levels"])) if part["whole"] else None)
                step = {s["entry"]: (s["exit"], s["closers"], s["openers"]) for s in part["steps"]}
                total = step if total is None else compose(total, step)
            steps = [{"entry": e, "exit": x, "closers": c, "openers": o} for e, (x, c, o) in total.items()]
            rows.append((repo, path, lang, block, summary is not None, *(summary or ([], [])), steps))
        yield pd.DataFrame(rows, columns=["repo_name", "file_path", "lang", "block", "whole", "asks", "levels", "steps"])


def with_language(chunks: DataFrame) -> DataFrame:
    """The chunks of the seven extensions, one row per place, with ``lang``; null content is empty."""
    lang = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    rows = chunks.select("repo_name", "file_path", lang.alias("lang"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.coalesce("content", F.lit("")).alias("content"))
    return rows.where(F.col("lang").isin(*LANGUAGES) & F.col("file_path").isNotNull())


def reduce_maps(mapped: DataFrame) -> DataFrame:
    """One row per file: ``whole`` (each chunk stands by itself) and the map from ``code``."""
    places = mapped.dropDuplicates(["repo_name", "file_path", "chunk_index"])
    part = F.struct(F.col("chunk_index").alias("at"), "whole", "asks", "levels", "steps")
    blocks = places.groupBy("repo_name", "file_path", "lang", F.floor(F.col("chunk_index") / BLOCK).cast("int").alias("block")).agg(F.collect_list(part).alias("parts"))
    folded = blocks.mapInPandas(_fold, PART)
    part = F.struct(F.col("block").alias("at"), "whole", "asks", "levels", "steps")
    files = folded.groupBy("repo_name", "file_path", "lang").agg(F.collect_list(part).alias("parts")).withColumn("block", F.lit(0))
    files = files.mapInPandas(_fold, PART)
    start = F.filter("steps", lambda s: s["entry"] == CODE)[0]
    balanced = (start["exit"] == CODE) & (start["closers"] == "") & (start["openers"] == "")
    unsure = start["exit"] == indents.UNSURE
    fits = F.col("whole") & ((F.size("asks") == 0) | ((F.size("asks") == 1) & (F.element_at("asks", 1) == 0)))
    return files.select("repo_name", "file_path", "lang", fits.alias("whole"), balanced.alias("balanced"), unsure.alias("unsure"))


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row is one file: its chunks, in any order."""
    for batch in batches:
        bad = []
        for parts, lang in zip(batch["parts"], batch["lang"], strict=True):
            texts = {p["chunk_index"]: p["content"] for p in parts}
            bad.append(not well_formed("\n\n".join(texts[i] for i in sorted(texts)), lang))
        yield batch.loc[bad, ["repo_name", "file_path", "lang"]]


def file_verdicts(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, malformed): every file of the languages, and the malformed ones; both (repo_name, file_path, lang).

    The texts of unsettled files are gathered by an aggregation, whose
    grouping every plan keeps: a join split over tasks cannot tear a file.
    """
    rows = with_language(chunks)
    files = cut_lineage(reduce_maps(rows.mapInPandas(_map_chunks, CHUNK)))
    told = F.col("balanced") | F.col("unsure") | F.col("lang").isin(*CUT_ANYWHERE)
    broken = files.where(~told).select("repo_name", "file_path", "lang")
    unsettled = files.where(told & ~(F.col("balanced") & F.col("whole"))).select(F.col("repo_name").alias("repo"), F.col("file_path").alias("path"))
    texts = rows.join(unsettled, F.col("repo_name").eqNullSafe(F.col("repo")) & (F.col("file_path") == F.col("path")), "left_semi")
    gathered = texts.groupBy("repo_name", "file_path", "lang").agg(F.collect_list(F.struct("chunk_index", "content")).alias("parts"))
    parsed = gathered.mapInPandas(_parse_files, "repo_name STRING, file_path STRING, lang STRING")
    return files.select("repo_name", "file_path", "lang"), broken.unionByName(parsed)


def malformed_files(chunks: DataFrame) -> DataFrame:
    """(repo_name, file_path, lang) of every file that does not parse."""
    return file_verdicts(chunks)[1]


def malformed_rates(chunks: DataFrame) -> DataFrame:
    """Files, malformed files and their rate per repository and language."""
    files, bad = file_verdicts(chunks)
    marked = files.withColumn("bad", F.lit(0)).unionByName(bad.withColumn("bad", F.lit(1)))
    counted = marked.groupBy("repo_name", "lang").agg(F.sum(1 - F.col("bad")).alias("files"), F.sum("bad").alias("malformed"))
    return counted.withColumn("rate", F.round(F.col("malformed") / F.col("files"), 4))
