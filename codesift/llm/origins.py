"""Generated, minified, vendored and data-only source files.

Every chunk gives counts that add up over a file (no text is moved): dense
long lines, literals, accessors, other definitions, and marks in the leading
comment.  They make the file's evidence, a log weight for each of five labels.
Directory names give evidence on directories.

Belief propagation runs on each repository's directory tree: directories are
hidden nodes of the same labels, a compatibility table ties a node to its
parent, and so siblings to each other through it.  A directory whose name says
what it holds has a table of its own, by which it hangs little on its parent
and tells it little.  On a tree the sum-product messages are exact after one
pass up and one down; each level is one grouped sum, with partial aggregation,
so a directory of many files is no hot group.

A file that a repository has from the one it was copied from (its
``simhash_source``), at the same path with the same text, takes the label of
the original: copying makes no file a vendored one.

Defined results: null content counts as empty; rows of a null repository are
files of one unnamed repository; files of other extensions and rows without a
path get no label; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from codesift.runtime import drop_table, write_table

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
EXTENSIONS = ("py", "js", "jsx", "ts", "tsx", "go", "rs")
COUNTS = ("chars", "dense", "blanks", "literal", "lines", "accessors", "defined")
CHUNK = "repo_name STRING, file_path STRING, chunk_index INT, made INT, taken INT, bare INT, digest BIGINT, " + ", ".join(f"{c} BIGINT" for c in COUNTS)

# How tools and people mark files, and how directories and files of each kind are named.
MADE = re.compile(
    r"(?i)code generated by|\bauto-?generated\b|@generated\b|\bgenerated (?:on \d|from\b|by\b.*(?:do not|v?\d+\.\d))|automatically (?:produced|generated|created)|regenerate with|do not (?:hand-?)?(?:edit|modify)|(?:changes|edits) will be (?:overwritten|lost)|this (?:file|code) (?:is|was) generated"
)
TAKEN = re.compile(r"(?i)\bvendored (?:from|copy)|bundled copy of|\bcopied from \S+ v?\d|imported without (?:changes|modification)|\borigin: \S+ v?\d|\bupstream:? (?:version|https?://)|keep in sync with upstream|\bv?\d+\.\d[\w.]*\s*\|\s*\(c\)|\(c\) the \S+ contributors|third[- ]party (?:code|library|source)")
VENDORED_DIRS = ("third_party", "third-party", "thirdparty", "vendor", "_vendor", "vendored", "extern", "external", "externals", "node_modules", "bower_components", "site-packages", "Godeps")
GENERATED_DIRS = ("generated", "__generated__", "gen", "autogen", "_generated")
_MADE_NAME = r"(?:_pb2(?:_grpc)?\.py|\.pb\.go|\.pb\.[a-z.]+|[._]generated\.[a-z]+|\.gen\.[a-z]+|_gen\.go|\.g\.[a-z]+)$"
_SMALL_NAME = r"(?:[.-]min\.[a-z]+|\.bundle\.js)$"
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|--|<!--)")
_LITERAL = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|\b\d[\d.]*\b,?[ \t]*|(?m:^[ \t]*[A-Za-z0-9+/]{48,}={0,2}[ \t]*$)")
_ACCESSOR = re.compile(
    r"(?m)\.prototype\.(?:get|set|has|clear|is)[A-Z_]\w*\s*=\s*function|^[ \t]*def (?:get|set|has|clear)_\w+\(\w*\)|^func \(\w+ \*?\w+\) (?:Get|Set|Has|Clear)[A-Z]\w*\(|^impl \w+ for \w+ \{[ \t]*\n[ \t]*const \w+|^[ \t]*readonly \w+: \d+;|\b_?registry\.lookup\(|\bdescriptor\.\w+\("
)
_DEFINED = re.compile(r"(?m)^[ \t]*(?:export )?(?:default )?(?:async )?(?:pub )?(?:def|func|fn|function|class)\b|=> ?\{[ \t]*$")

# Log weights of evidence, and how labels of a directory go on to what it holds (rows: parent).
STRONG, NAMED, PLAIN = 8.0, 5.5, 5.0
PASSES_ON = (
    (0.9, 0.025, 0.025, 0.025, 0.025),
    (0.002, 0.992, 0.002, 0.002, 0.002),
    (0.02, 0.02, 0.92, 0.02, 0.02),
    (0.00025, 0.00025, 0.00025, 0.999, 0.00025),
    (0.02, 0.02, 0.02, 0.02, 0.92),
)
# The same for directories named for vendored or for generated files.
NAMED_VENDORED = ((0.06, 0.01, 0.01, 0.91, 0.01),) * 3 + ((0.001, 0.001, 0.001, 0.996, 0.001), (0.06, 0.01, 0.01, 0.91, 0.01))
NAMED_GENERATED = ((0.06, 0.91, 0.01, 0.01, 0.01),) * 3 + ((0.001, 0.001, 0.001, 0.996, 0.001), (0.06, 0.91, 0.01, 0.01, 0.01))
# A directory turns vendored only by its name, or by many marked files in it.
TURNS = 1e-7
ROOT = (0.997, 0.001, 0.001, TURNS, 0.001)
# Among vendored files, half carry a mark of their origin.
UNMARKED = 0.7


def leading_comment(text: str) -> tuple[str, bool]:
    """(the comment lines at the start, past a package clause or shebang; whether there is nothing else)."""
    out, inside = [], False
    for i, line in enumerate(text.split("\n")):
        bare = line.strip()
        if inside:
            out.append(bare)
            inside = "*/" not in bare and '"""' not in bare
        elif not bare or (i < 3 and (bare.startswith("package ") or bare in ('"use strict";', "'use strict';"))):
            continue
        elif bare.startswith(("/*", '"""')):
            out.append(bare)
            inside = "*/" not in bare if bare.startswith("/*") else bare.count('"""') < 2
        elif _COMMENT.match(bare):
            out.append(bare)
        else:
            return "\n".join(out), False
    return "\n".join(out), True


def chunk_counts(text: str, first: bool) -> tuple[int, ...]:
    """(made, taken, bare, *COUNTS) of one chunk."""
    made = taken = bare = 0
    if first:
        head, only = leading_comment(text)
        made, taken, bare = int(MADE.search(head) is not None), int(TAKEN.search(head) is not None), int(only)
    lines = text.split("\n")
    dense = sum(len(x) for x in lines if len(x) > 300)
    blanks = sum(x.count(" ") + x.count("\t") for x in lines if len(x) > 300)
    literal = sum(m.end() - m.start() for m in _LITERAL.finditer(text))
    return made, taken, bare, len(text), dense, blanks, literal, sum(1 for x in lines if x.strip()), len(_ACCESSOR.findall(text)), len(_DEFINED.findall(text))


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(r, p, i, *(c := chunk_counts(t, i < 2))[:3], d, *c[3:]) for r, p, i, d, t in zip(batch["repo_name"], batch["file_path"], batch["chunk_index"], batch["digest"], batch["content"], strict=True)]
        yield pd.DataFrame(rows, columns=["repo_name", "file_path", "chunk_index", "made", "taken", "bare", "digest", *COUNTS])


def file_counts(chunks: DataFrame) -> DataFrame:
    """One row per file: marks, counts and a digest of its text."""
    content = F.coalesce("content", F.lit(""))
    rows = chunks.where(F.col("file_path").isNotNull() & F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1)).isin(*EXTENSIONS))
    rows = rows.select("repo_name", "file_path", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.xxhash64(content, F.coalesce("chunk_index", F.lit(0))).alias("digest"), content.alias("content"))
    counted = rows.mapInPandas(_count_batches, CHUNK)
    places = counted.groupBy("repo_name", "file_path", "chunk_index").agg(*[F.max(c).alias(c) for c in ("made", "taken", "bare", "digest", *COUNTS)])
    first = lambda c, at: F.max(F.when(F.col("chunk_index") == at, F.col(c)).otherwise(0))
    mark = lambda c: F.greatest(first(c, 0), first("bare", 0) * first(c, 1))
    return places.groupBy("repo_name", "file_path").agg(mark("made").alias("made"), mark("taken").alias("taken"), F.expr("bit_xor(digest)").alias("digest"), *[F.sum(c).alias(c) for c in COUNTS])


def evidence(files: DataFrame) -> DataFrame:
    """(repo_name, file_path, digest, e0 .. e4): the log weight of each label."""
    name = F.regexp_extract("file_path", r"[^/]*$", 0)
    chars = F.greatest("chars", F.lit(1))
    blob = (F.col("literal") / chars > 0.7) & (F.col("defined") == 0) & (F.col("chars") >= 200)
    dense = (F.col("dense") / chars > 0.6) & (F.col("blanks") / F.greatest("dense", F.lit(1)) < 0.12) & ~blob & (F.col("chars") >= 300)
    accessors = (F.col("accessors") >= 2) & (F.col("accessors") / F.greatest("lines", F.lit(1)) >= 0.12) & (F.col("defined") <= 1.2 * F.col("accessors") + 1)
    weigh = lambda *parts: sum((F.when(c, w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    made = weigh((F.col("made") == 1, STRONG), (name.rlike(_MADE_NAME), NAMED), (accessors, STRONG))
    small = weigh((dense, STRONG + 4), (name.rlike(_SMALL_NAME), NAMED))
    taken = weigh((F.col("taken") == 1, STRONG))
    data = weigh((blob, STRONG))
    # what looks written by hand counts only where no tool claims it
    plain = F.when(~dense & ~blob & ~accessors & (F.col("made") == 0), F.lit(PLAIN)).otherwise(0.0)
    # third-party source looks like the repository's own; only marks and places tell
    looks = F.when(F.col("taken") == 1, plain).otherwise(F.greatest(plain - UNMARKED, F.lit(0.0)))
    return files.select("repo_name", "file_path", "digest", plain.alias("e0"), made.alias("e1"), small.alias("e2"), (taken + looks).alias("e3"), data.alias("e4"))


def _tables() -> np.ndarray:
    """By kind: what ties a file, a directory, and one named for vendored or generated files to its parent."""
    plain = np.array(PASSES_ON)
    plain[[p for p in range(5) if LABELS[p] != "vendored"], LABELS.index("vendored")] = TURNS
    return np.array([PASSES_ON, plain, NAMED_VENDORED, NAMED_GENERATED])


def _message(upwards: bool):
    """A column function of a node's kind and log weights: the message to its parent, or from its parent to it."""
    tables = _tables()
    tables = tables.transpose(0, 2, 1) if upwards else tables

    def send(kind: pd.Series, *weights: pd.Series) -> pd.DataFrame:
        logs = np.column_stack(weights)
        logs -= logs.max(axis=1, keepdims=True)
        return pd.DataFrame(np.log(np.einsum("ni,nij->nj", np.exp(logs), tables[kind.to_numpy()])), columns=M)

    # the annotations of a variable number of columns tell Spark nothing, so the kind is named
    return F.pandas_udf(send, ", ".join(f"{m} DOUBLE" for m in M), PandasUDFType.SCALAR)


M = [f"m{i}" for i in range(5)]
E = [f"e{i}" for i in range(5)]
UP = [f"u{i}" for i in range(5)]
IN = [f"i{i}" for i in range(5)]


# What stands for a null repository in joins; no repository has a line end in its name.
NO_REPOSITORY = "\n"
FILE, PLAIN_DIR, VENDORED_DIR, GENERATED_DIR = range(4)


def directory_kind() -> Column:
    name = F.regexp_extract("dir", r"[^/]*$", 0)
    return F.when(name.isin(*VENDORED_DIRS), VENDORED_DIR).when(name.isin(*GENERATED_DIRS), GENERATED_DIR).otherwise(PLAIN_DIR)


def directory_weights() -> list[Column]:
    weigh = lambda kind, weight: F.when(F.col("kind") == kind, F.lit(weight)).otherwise(0.0)
    return [F.lit(0.0), weigh(GENERATED_DIR, STRONG + 1.5), F.lit(0.0), weigh(VENDORED_DIR, 3 * STRONG - 2.5), F.lit(0.0)]


def propagate(files: DataFrame) -> DataFrame:
    """(repo_name, file_path, digest, label, belief) from ``evidence``.

    The levels of the tree are written one by one, so the plan of a level does
    not hold those of the levels before; there are as many as the deepest path
    has directories.  The tables go once the result is written.
    """
    used: list[DataFrame] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        used.append(write_table(df, name))
        return used[-1]

    parent = lambda path: F.regexp_replace(path, r"/?[^/]*$", "")
    leaves = files.withColumn("repo_name", F.coalesce("repo_name", F.lit(NO_REPOSITORY))).withColumn("dir", parent(F.col("file_path")))
    leaves = leaves.withColumn("m", _message(True)(F.lit(FILE), *E))
    leaves = written(leaves.select("repo_name", "file_path", "digest", "dir", *E, "m.*"), "leaves")
    # all directories above the files, and what each hears from its own files
    heard = leaves.groupBy("repo_name", "dir").agg(*[F.sum(m).alias(u) for m, u in zip(M, UP, strict=True)])
    depth = lambda d: F.when(d == "", F.lit(0)).otherwise(F.size(F.split(d, "/")))
    parts = F.split("dir", "/")
    above = heard.select("repo_name", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(depth(F.col("dir")) - 1, F.lit(0))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    above = above.union(heard.select("repo_name", "dir")).distinct()
    dirs = above.join(heard, ["repo_name", "dir"], "left").withColumn("depth", depth(F.col("dir"))).withColumn("kind", directory_kind())
    dirs = dirs.select("repo_name", "dir", "depth", "kind", *[(F.coalesce(u, F.lit(0.0)) + w).alias(u) for u, w in zip(UP, directory_weights(), strict=True)])
    dirs = written(dirs, "dirs")
    deepest = dirs.agg(F.max("depth")).first()[0] or 0
    # up: from the deepest level, each directory adds its message to its parent
    sent: dict[int, DataFrame] = {}
    for d in range(deepest, -1, -1):
        own = dirs.where(F.col("depth") == d)
        if d < deepest:
            sums = sent[d + 1].groupBy("repo_name", F.col("parent").alias("dir")).agg(*[F.sum(m).alias(m) for m in M])
            own = own.join(sums, ["repo_name", "dir"], "left").select("repo_name", "dir", "kind", *[(F.col(u) + F.coalesce(m, F.lit(0.0))).alias(u) for u, m in zip(UP, M, strict=True)])
        own = own.withColumn("parent", parent(F.col("dir"))).withColumn("m", _message(True)(F.col("kind"), *UP))
        sent[d] = written(own.select("repo_name", "dir", "parent", "kind", *UP, "m.*"), "up")
    # down: what the rest of the tree says about each directory
    beliefs = written(sent[0].select("repo_name", "dir", *[(F.col(u) + F.lit(math.log(r))).alias(b) for u, r, b in zip(UP, ROOT, IN, strict=True)]), "down")
    known = beliefs
    for d in range(1, deepest + 1):
        joined = sent[d].join(beliefs.select("repo_name", F.col("dir").alias("parent"), *IN), ["repo_name", "parent"])
        joined = joined.withColumn("r", _message(False)(F.col("kind"), *[F.col(i) - F.col(m) for i, m in zip(IN, M, strict=True)]))
        beliefs = written(joined.select("repo_name", "dir", *[(F.col(u) + F.col(f"r.{m}")).alias(i) for u, m, i in zip(UP, M, IN, strict=True)]), "down")
        known = known.unionByName(beliefs)
    joined = leaves.join(known, ["repo_name", "dir"])
    joined = joined.withColumn("r", _message(False)(F.lit(FILE), *[F.col(i) - F.col(m) for i, m in zip(IN, M, strict=True)]))
    weighed = joined.select("repo_name", "file_path", "digest", *[(F.col(e) + F.col(f"r.{m}")).alias(e) for e, m in zip(E, M, strict=True)])
    best = F.greatest(*[F.struct(F.col(e).alias("w"), F.lit(name).alias("label")) for e, name in zip(E, LABELS, strict=True)])
    total = sum((F.exp(F.col(e) - F.col("best.w")) for e in E), F.lit(0.0))
    weighed = weighed.withColumn("best", best)
    found = write_table(weighed.select(F.nullif("repo_name", F.lit(NO_REPOSITORY)).alias("repo_name"), "file_path", "digest", F.col("best.label").alias("label"), F.round(1 / total, 4).alias("belief")), "origins")
    for table in used:
        drop_table(table)
    return found


def file_origins(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """(repo_name, file_path, label, belief, copied) of every file; ``runs`` names the repositories' sources."""
    found = propagate(evidence(file_counts(chunks)))
    sources = runs.where("simhash_source IS NOT NULL AND repo_name IS NOT NULL AND simhash_source <> repo_name").select("repo_name", F.col("simhash_source").alias("source")).distinct()
    originals = found.select(F.col("repo_name").alias("source"), "file_path", "digest", F.col("label").alias("original"), F.col("belief").alias("sure"))
    copied = found.select("repo_name", "file_path", "digest").join(sources, "repo_name").join(originals, ["source", "file_path", "digest"])
    copied = copied.groupBy("repo_name", "file_path").agg(F.max(F.struct("sure", "original")).alias("from"))
    joined = found.join(copied.withColumnsRenamed({"repo_name": "r", "file_path": "p"}), F.col("repo_name").eqNullSafe(F.col("r")) & (F.col("file_path") == F.col("p")), "left")
    return joined.select("repo_name", "file_path", F.coalesce(F.col("from.original"), "label").alias("label"), F.coalesce(F.col("from.sure"), "belief").alias("belief"), F.col("from").isNotNull().alias("copied"))


def not_handwritten(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """(repo_name, file_path, label) of every file that people of its repository did not write."""
    return file_origins(chunks, runs).where("label <> 'handwritten'").select("repo_name", "file_path", "label")


def handwritten_rows(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """The chunks of hand-written source only."""
    keep = file_origins(chunks, runs).where("label = 'handwritten'").select("repo_name", "file_path")
    keep = keep.toDF("r", "p")
    return chunks.join(keep, F.col("repo_name").eqNullSafe(F.col("r")) & (F.col("file_path") == F.col("p")), "left_semi")
