"""Texts shown to reviewers and models: numbered source, sections of findings, summaries, and context from other files.

Every text is one aggregation of ordered parts inside the JVM.  A text belongs
to one file, review or agent and is as long as what it shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.operators.diffs import widen
from codesift.operators.reviews import AGENTS, SEVERITIES, rank_of, severity_name
from codesift.operators.search import callers, dependents, first_few

# What a critical finding asks for, and up to how many lines a file is shown whole.
REQUEST, COMMENT = "REQUEST_CHANGES", "COMMENT"
WHOLE, AROUND = 500, 30


def ordered_text(order: Column, text: Column, between: str = "\n") -> Column:
    """An aggregate: the texts in order, with ``between`` between them."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("at"), text.alias("text"))))
    return F.array_join(F.transform(parts, lambda p: p["text"]), between)


def line_mark(number: Column) -> Column:
    """``L`` and the number, to the right of at least four places."""
    shown = number.cast("string")
    return F.concat(F.lit("L"), F.repeat(F.lit(" "), F.greatest(F.lit(0), 4 - F.length(shown))), shown, F.lit(": "))


def verdicts(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """(review_id, verdict): changes are requested where a finding is critical; a review without findings comments."""
    worst = findings.where(severity_name(F.col("severity")) == "CRITICAL").select("review_id").distinct().withColumn("critical", F.lit(True))
    return reviews.select("review_id").join(worst, "review_id", "left").select("review_id", F.when(F.col("critical"), REQUEST).otherwise(COMMENT).alias("verdict"))


def numbered_source(files: DataFrame, hunks: DataFrame, whole: int = WHOLE, around: int = AROUND) -> DataFrame:
    """(repo_name, file_path, lines, shown): numbered source of each file.

    A file of at most ``whole`` lines is shown whole; a larger one by its
    changed regions, ``hunks`` of (repo_name, file_path, first, last), with
    ``around`` lines about them and a note for what lies between; without a
    region it is named only.  A null text counts as empty.
    """
    rows = files.select("repo_name", "file_path", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("source")).withColumn("lines", F.size("source"))
    ends = hunks.join(rows.where(F.col("lines") > whole).select("repo_name", "file_path", "lines"), ["repo_name", "file_path"])
    wide = widen(ends.where(F.col("first") <= F.col("lines")), ["repo_name", "file_path", "lines"], around, F.col("lines"))
    regions = wide.groupBy("repo_name", "file_path").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("regions"))
    joined = rows.join(regions, ["repo_name", "file_path"], "left")
    numbered = lambda source, start: F.array_join(F.transform(source, lambda x, i: F.concat(line_mark(i + start), x)), "\n")
    cut = lambda r: numbered(F.slice("source", r["first"], r["last"] - r["first"] + 1), r["first"])
    note = lambda r, i: F.when(i > 0, F.concat(F.lit("  ... (lines "), (F.col("regions")[i - 1]["last"] + 1).cast("string"), F.lit("-"), (r["first"] - 1).cast("string"), F.lit(" omitted) ...\n"))).otherwise("")
    parts = F.array_join(F.transform("regions", lambda r, i: F.concat(note(r, i), cut(r))), "\n")
    head = F.concat(F.lit("### "), "file_path", F.lit(" ("), F.col("lines").cast("string"), F.lit(" lines"))
    fence = lambda text: F.concat(F.lit("\n```\n"), text, F.lit("\n```"))
    shown = (
        F.when(F.col("lines") <= whole, F.concat(head, F.lit(", whole file)"), fence(numbered(F.col("source"), F.lit(1)))))
        .when(F.col("regions").isNull(), F.concat(head, F.lit(", too large, nothing changed)")))
        .otherwise(F.concat(head, F.lit(f", changed regions and {around} lines around)"), fence(parts)))
    )
    return joined.select("repo_name", "file_path", "lines", shown.alias("shown"))


def finding_line(fix: bool = True) -> Column:
    """A finding as an item of a list, with its code before and after where both are known."""
    line = F.concat(F.lit("- `"), F.coalesce("file_path", F.lit("?")), F.lit(":"), F.coalesce(F.col("line_number").cast("string"), F.lit("?")), F.lit("` — "), F.coalesce("description", F.lit("")))
    change = F.concat(F.lit("\n```diff\n- "), F.trim("current_code"), F.lit("\n+ "), F.trim("suggested_fix"), F.lit("\n```"))
    return F.concat(line, F.when((F.length("current_code") > 0) & (F.length("suggested_fix") > 0), change).otherwise("")) if fix else line


def sections(findings: DataFrame) -> DataFrame:
    """(review_id, agent, findings, section): the findings of an agent under a heading for each severity, most severe first."""
    rows = findings.select("review_id", "agent", "finding_id", rank_of(severity_name(F.col("severity")), SEVERITIES).alias("rank"), finding_line().alias("line"))
    grouped = rows.groupBy("review_id", "agent", "rank").agg(F.count(F.lit(1)).alias("n"), ordered_text(F.col("finding_id"), F.col("line")).alias("lines"))
    name = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("rank"))
    block = F.concat(F.lit("### "), name, F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), "lines")
    return grouped.groupBy("review_id", "agent").agg(F.sum("n").alias("findings"), ordered_text(F.col("rank"), block, "\n\n").alias("section"))


def summaries(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """(review_id, verdict, summary): each review's comment, with a foldable section for each agent that found something."""
    own = sections(findings.where("review_id IS NOT NULL"))
    folded = F.concat(F.lit("<details>\n<summary>"), F.initcap(F.coalesce("agent", F.lit("other"))), F.lit(" ("), F.col("findings").cast("string"), F.lit(")</summary>\n\n"), "section", F.lit("\n\n</details>"))
    turn = F.struct(rank_of(F.col("agent"), AGENTS).alias("turn"), F.coalesce("agent", F.lit("")).alias("agent"))
    parts = own.groupBy("review_id").agg(F.sum("findings").alias("findings"), ordered_text(turn, folded, "\n\n").alias("parts"))
    joined = verdicts(findings, reviews).join(parts, "review_id", "left")
    found = F.concat(F.lit("Found "), F.col("findings").cast("string"), F.when(F.col("findings") == 1, " issue.").otherwise(" issues."), F.lit("\n\n"), "parts")
    return joined.select("review_id", "verdict", F.concat(F.lit("## Code review\n\n"), F.coalesce(found, F.lit("No issues found."))).alias("summary"))


def cross_file_context(changed: DataFrame, chunks: DataFrame, most: int = 5) -> DataFrame:
    """(repo_name, file_path, context): for each changed file who imports it and who calls what it defines, the first ``most`` of each.

    Files and callers that are changed themselves are not listed.
    """
    changed = changed.select("repo_name", "file_path").distinct()
    other = changed.withColumnRenamed("file_path", "dependent")
    imports = dependents(chunks).join(changed, ["repo_name", "file_path"], "left_semi").join(other, ["repo_name", "dependent"], "left_anti")
    imports = first_few(imports, ["repo_name", "file_path"], ["dependent"], most)
    imported = imports.groupBy("repo_name", "file_path").agg(ordered_text(F.col("place"), F.concat(F.lit("  - `"), "dependent", F.lit("`"))).alias("text"))
    imported = imported.select("repo_name", "file_path", F.concat(F.lit("**Imported by:**\n"), "text").alias("text"), F.lit("").alias("symbol"))
    calls = callers(chunks).select("repo_name", "symbol", F.col("defined_in").alias("file_path"), F.col("called_in").alias("dependent")).distinct()
    calls = calls.join(changed, ["repo_name", "file_path"], "left_semi").join(other, ["repo_name", "dependent"], "left_anti")
    calls = first_few(calls, ["repo_name", "file_path", "symbol"], ["dependent"], most)
    called = calls.groupBy("repo_name", "file_path", "symbol").agg(ordered_text(F.col("place"), F.concat(F.lit("  - `"), "dependent", F.lit("`"))).alias("text"))
    called = called.select("repo_name", "file_path", F.concat(F.lit("**`"), "symbol", F.lit("()` is called by:**\n"), "text").alias("text"), "symbol")
    both = imported.unionByName(called).groupBy("repo_name", "file_path").agg(ordered_text(F.col("symbol"), F.col("text"), "\n\n").alias("text"))
    return both.select("repo_name", "file_path", F.concat(F.lit("### "), "file_path", F.lit(" (changed)\n"), "text").alias("context"))


def structure_text(graphs: DataFrame) -> DataFrame:
    """(repo_name, file_path, text): what a file defines, in three lines."""
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    return graphs.select("repo_name", "file_path", F.concat(F.lit("- "), "file_path", F.lit("\n  Functions: "), listed("functions"), F.lit("\n  Classes: "), listed("classes")).alias("text"))
