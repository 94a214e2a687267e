"""Best representative of each duplicate group.

Rows that report one issue are reduced to one surviving record.  Criteria are
completeness (usable fields), trust (confidence, then severity) and recency.

1. Rows of an issue that agree in the fields that are usable, in confidence
   and in severity are one cell; its latest row beats or equals the others in
   everything, so a partial aggregation keeps that one.
2. A record that another with the same usable fields beats can neither win nor
   fill a field, so it takes no part.  These fronts are taken first in salted
   parts of an issue, without gathering it: what reaches one task is, for each
   of 32 sets of usable fields, the records of which a less trusted one is
   always later.
3. What is left is cut into dominance layers: layer 1 is the skyline, of
   records that no other beats or equals in all criteria and beats in one;
   layer 2 the skyline of the rest, and so on.  One sweep finds all layers.
4. The lexicographic policy picks the survivor from the skyline.  Fields it
   lacks are filled from the nearest layer that has them, by the same policy.
   Texts are joined by ``finding_id`` at the end, so only those of survivors
   and fills ever move.

The policy: most usable fields, highest usable confidence, most severe, latest
``created_at`` (null earliest), smallest ``finding_id``.  Its winner is never
dominated, so it is in the skyline.

Rows without a review, a usable path, a category or a line of at least 1
report an issue of their own.  Repeated rows are rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesift.runtime import write_table

# Ranks of severities, and what stands for "nothing" in a text.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
NOTHING = ("", "-", "--", "---", ".", "..", "...", "?", "n/a", "na", "n.a.", "nan", "nil", "none", "null", "nothing", "todo", "tbd", "fixme", "undefined", "unknown", "empty", "no", "not available", "not applicable")
TEXTS = ("description", "current_code", "suggested_fix")
FIELDS = ("severity", *TEXTS, "confidence")

SALTS = 16
NEVER = -(2**62)

LAYERED = "group_id BIGINT, survivor_id BIGINT, skyline BIGINT, layers INT, " + ", ".join(f"from_{f} BIGINT" for f in FIELDS)


def usable_text(column: Column) -> Column:
    """The text, or null where it says nothing."""
    bare = F.lower(F.regexp_replace(column, r"^[\s\x{a0}]+|[\s\x{a0}]+$", ""))
    return F.when(~bare.isin(*NOTHING), column)


def usable_severity(column: Column) -> Column:
    name = F.upper(F.trim(F.regexp_replace(column, r"\s+", " ")))
    return F.when(name.isin(*SEVERITIES), name)


def severity_rank(column: Column) -> Column:
    ranks = F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i + 1))])
    return F.coalesce(ranks[column], F.lit(0))


def usable_confidence(column: Column) -> Column:
    return F.when((column >= 0) & (column <= 1) & ~F.isnan(column), column)


def canonical_path(path: Column, repo: Column) -> Column:
    """One spelling of a path within its repository: no host separators, ``./``, diff sides, doubled or leading slashes, or repository name."""
    slashes = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), "/(?:\\./)*/*", "/")
    bare = F.regexp_replace(slashes, r"^(?:\./|/)+", "")
    inside = F.when(F.startswith(bare, F.concat(repo, F.lit("/"))), F.substr(bare, F.length(repo) + 2)).otherwise(bare)
    return F.regexp_replace(inside, r"^[ab]/", "")


def reports(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """The rows with usable values and their issue; ``known`` is false for those that report one of their own.

    What is usable is told before the repository is joined, so texts do not
    move where only their presence counts.  The key of the join is not that of
    the issue, so the planner may split a review that holds many rows.
    """
    repos = reviews.select("review_id", "repo_name").where("review_id IS NOT NULL").groupBy("review_id").agg(F.min("repo_name").alias("repo_name"))
    category = F.lower(F.trim(F.regexp_replace("category", r"\s+", " ")))
    rows = findings.select(
        "finding_id", "review_id", "file_path", "line_number", category.alias("kind"), "created_at",
        usable_severity(F.col("severity")).alias("severity"), *[usable_text(F.col(t)).alias(t) for t in TEXTS], usable_confidence(F.col("confidence")).alias("confidence"),
    )
    rows = rows.withColumn("mask", sum(F.shiftleft(F.col(f).isNotNull().cast("int"), i) for i, f in enumerate(FIELDS))).withColumn("rank", severity_rank(F.col("severity")))
    rows = rows.join(repos, "review_id", "left")
    path = canonical_path(F.col("file_path"), F.coalesce("repo_name", F.lit("\u0000")))
    known = F.col("review_id").isNotNull() & (F.col("line_number") >= 1) & (path != "") & (F.col("kind") != "")
    return rows.select("finding_id", F.concat("review_id", F.lit("")).alias("review_id"), path.alias("path"), "line_number", "kind", "created_at", "mask", "rank", F.coalesce(known, F.lit(False)).alias("known"), *FIELDS)


ISSUE = ("review_id", "path", "line_number", "kind")


def cells(rows: DataFrame) -> DataFrame:
    """One record per issue, set of usable fields, confidence and severity: the latest of its rows, with their count and smallest id."""
    trust, at = F.coalesce("confidence", F.lit(-1.0)), F.coalesce(F.unix_micros("created_at"), F.lit(NEVER))
    keyed = rows.where("known").select(*ISSUE, "finding_id", "mask", F.bit_count("mask").alias("usable"), trust.alias("trust"), "rank", at.alias("at"))
    latest = F.max(F.struct("at", (-F.col("finding_id")).alias("minus_id")))
    return keyed.groupBy(*ISSUE, "mask", "usable", "trust", "rank").agg(latest.alias("latest"), F.count(F.lit(1)).alias("n"), F.min("finding_id").alias("least"))


def fronts(found: DataFrame) -> DataFrame:
    """The cells, each marked whether it is in the front of its issue's salted part: later than all that are more trusted, with the same fields."""
    salt = F.pmod(F.xxhash64("trust", "rank"), F.lit(SALTS))
    before = Window.partitionBy(*ISSUE, "mask", salt).orderBy(F.col("trust").desc(), F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("front", F.coalesce(F.col("latest.at") > F.max("latest.at").over(before), F.lit(True)))


def peel(records: list[tuple[int, float, int, int]]) -> list[int]:
    """Dominance layer, from 1, of each distinct (usable, trust, rank, recency).

    The layer is one more than the deepest among those that dominate it.  In
    order of trust, ``latest[u][l]`` is the latest record so far of at least u
    usable fields in layer l or deeper; it falls with l, so a search finds the
    deepest layer with a record that is later.
    """
    latest: dict[int, list[int]] = {u: [] for u in {r[0] for r in records}}
    layers = [0] * len(records)
    for i in sorted(range(len(records)), key=lambda i: (records[i][1], records[i][2], records[i][3], records[i][0]), reverse=True):
        usable, at = records[i][0], records[i][3]
        # negated, the list rises: the first entry above -at is the first layer without a record as late
        layer = _rank(latest[usable], at)
        layers[i] = layer + 1
        for u, own in latest.items():
            if u <= usable:
                if layer == len(own):
                    own.append(-at)
                elif own[layer] > -at:
                    own[layer] = -at
    return layers


def _rank(negated: list[int], at: int) -> int:
    return bisect_left(negated, -at + 1)


def _front(records: list[dict]) -> list[dict]:
    """The records that no other with the same usable fields beats; best first by policy."""
    latest: dict[int, int] = {}
    kept = []
    for r in sorted(records, key=lambda r: (r["trust"], r["rank"], r["at"]), reverse=True):
        if r["at"] > latest.get(r["mask"], NEVER - 1):
            latest[r["mask"]] = r["at"]
            kept.append(r)
    return sorted(kept, key=lambda r: (r["usable"], r["trust"], r["rank"], r["at"], r["minus_id"]), reverse=True)


def _layer_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for group, found in zip(batch["group_id"], batch["records"], strict=True):
            records = _front(found)
            places = [(r["usable"], r["trust"], r["rank"], r["at"]) for r in records]
            distinct = sorted(set(places), reverse=True)
            layer_of = dict(zip(distinct, peel(distinct), strict=True))
            layers = [layer_of[p] for p in places]
            best, nearest = records[0], sorted(range(len(records)), key=lambda i: (layers[i], i))
            sources = []
            for bit in range(len(FIELDS)):
                has = best if best["mask"] >> bit & 1 else next((records[i] for i in nearest if records[i]["mask"] >> bit & 1), None)
                sources.append(None if has is None else -has["minus_id"])
            out.append((group, -best["minus_id"], layers.count(1), max(layers), *sources))
        frame = pd.DataFrame(out, columns=["group_id", "survivor_id", "skyline", "layers", *(f"from_{f}" for f in FIELDS)])
        yield frame.astype({f"from_{f}": "Int64" for f in FIELDS})


def layered(found: DataFrame) -> DataFrame:
    """(group_id, survivor_id, skyline, layers, from_...) of each issue of at least two rows: the ids of the rows that give each field."""
    record = F.struct("mask", "usable", "trust", "rank", F.col("latest.at").alias("at"), F.col("latest.minus_id").alias("minus_id"))
    groups = fronts(found).groupBy(*ISSUE).agg(F.min("least").alias("group_id"), F.sum("n").alias("n"), F.collect_list(F.when(F.col("front"), record)).alias("records")).where("n > 1")
    return groups.select("group_id", "records").mapInPandas(_layer_batches, LAYERED)


def filled(issues: DataFrame, rows: DataFrame) -> DataFrame:
    """The issues with the values of their fields in place of ``from_...``, and ``filled``, the fields not the survivor's own."""
    issues = write_table(issues, "issues")  # read twice below
    own = rows.select(F.col("finding_id").alias("survivor_id"), *FIELDS)
    with_own = issues.join(own, "survivor_id")
    other = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"from_{f}").alias("finding_id")) for f in FIELDS]), lambda s: s["finding_id"] != F.col("survivor_id"))
    wanted = issues.select("group_id", "survivor_id", F.explode(other).alias("s")).select("group_id", "s.field", "s.finding_id")
    given = wanted.join(rows.select("finding_id", *[F.col(f).alias(f"g_{f}") for f in FIELDS]), "finding_id")
    given = given.groupBy("group_id").agg(*[F.max(F.when(F.col("field") == f, F.col(f"g_{f}"))).alias(f"g_{f}") for f in FIELDS], F.array_sort(F.collect_set("field")).alias("filled"))
    return with_own.join(given, "group_id", "left").select("group_id", "survivor_id", "skyline", "layers", *[F.coalesce(f, f"g_{f}").alias(f) for f in FIELDS], F.coalesce("filled", F.array().cast("array<string>")).alias("filled"))


def survivors_of(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """(group_id, survivor_id, skyline, layers, from_...): one row per issue reported at least twice."""
    return layered(cells(reports(findings, reviews)))


def best_of_duplicates(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per issue reported at least twice: survivor, skyline size, layers, and the fields as filled."""
    rows = reports(findings, reviews)
    return filled(layered(cells(rows)), rows)


def one_per_issue(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per issue, reported once or often, with path and line in one spelling."""
    rows = reports(findings, reviews)
    found = cells(rows)
    home = rows.select(F.col("finding_id").alias("survivor_id"), "review_id", F.col("path").alias("file_path"), "line_number", F.col("kind").alias("category"), *[F.col(f).alias(f"o_{f}") for f in FIELDS])
    several = filled(layered(found), rows).select("group_id", "survivor_id", *FIELDS)
    # a row that is alone keeps its own values
    nothing = [F.lit(None).cast("double" if f == "confidence" else "string").alias(f) for f in FIELDS]
    alone = found.groupBy(*ISSUE).agg(F.min("least").alias("group_id"), F.sum("n").alias("n")).where("n = 1").select("group_id", F.col("group_id").alias("survivor_id"), *nothing)
    own = rows.where("NOT known").select(F.col("finding_id").alias("group_id"), F.col("finding_id").alias("survivor_id"), *nothing)
    every = several.unionByName(alone).unionByName(own)
    return every.join(home, "survivor_id").select("group_id", "survivor_id", "review_id", "file_path", "line_number", "category", *[F.coalesce(f, f"o_{f}").alias(f) for f in FIELDS])
