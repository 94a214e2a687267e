"""All queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.llm import cutting, leaks, neardup, origins, packing, reading, secrets, survivors, syntax
from codesift.runtime import spread
from codesift.sources.tables import table


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "chunks"), "chunk_id")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = cutting.cut_oversized(table(spark, folder, "chunks"), table(spark, folder, "size_limits"))
    return pieces.where("piece_index = 0").select("chunk_id")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return cutting.split_oversized(table(spark, folder, "chunks"), table(spark, folder, "size_limits"))


def p1_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Each oversized item put together again from its pieces, all of them within the largest limit."""
    found = cutting.rebuilt(p1_pieces(spark, folder))
    return found.select("chunk_id", (F.col("pieces") > 1).alias("cut"), "text_hash")


def p1_overlong(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces, and pieces longer than their type allows (none), by type."""
    kind = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    sizes = table(spark, folder, "size_limits").select(F.lower(F.trim("chunk_type")).alias("kind"), "max_chars")
    pieces = p1_pieces(spark, folder).withColumn("kind", kind("chunk_type")).join(sizes, "kind")
    return pieces.groupBy("kind").agg(F.countDistinct("chunk_id").alias("items"), F.count_if(F.length("content") > F.col("max_chars")).alias("overlong"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.malformed_files(_chunks(spark, folder)).select("repo_name", "file_path")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.malformed_rates(_chunks(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return origins.not_handwritten(_chunks(spark, folder), table(spark, folder, "index_stats")).select("repo_name", "file_path")


def p3_labels(spark: SparkSession, folder: str) -> DataFrame:
    return origins.file_origins(_chunks(spark, folder), table(spark, folder, "index_stats"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.survivors_of(table(spark, folder, "findings"), table(spark, folder, "reviews")).select("group_id", "survivor_id")


def p4_issues(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.one_per_issue(table(spark, folder, "findings"), table(spark, folder, "reviews"))


def _near(spark: SparkSession, folder: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(_chunks(spark, folder), neardup.Join(words=3, least_words=30, numerator=7, denominator=10))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).row_pairs()


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).groups()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = secrets.credentials(_chunks(spark, folder), "chunk_id", "content", F.col("file_path"))
    static = secrets.credentials(table(spark, folder, "static_findings"), "static_id", "matched_code", F.col("file"))
    both = chunks.withColumn("tbl", F.lit("chunks")).unionByName(static.withColumn("tbl", F.lit("static_findings")))
    return both.select("tbl", "row_id", "line_no")


def p6_masked(spark: SparkSession, folder: str) -> DataFrame:
    chunks = secrets.without_credentials(_chunks(spark, folder), "chunk_id", "content", F.col("file_path"))
    static = secrets.without_credentials(table(spark, folder, "static_findings"), "static_id", "matched_code", F.col("file"))
    both = chunks.withColumn("tbl", F.lit("chunks")).unionByName(static.withColumn("tbl", F.lit("static_findings")))
    return both.select("tbl", "row_id", "text", "masked")


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), table(spark, folder, "packing_specs"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_rates(p8_packed(spark, folder), table(spark, folder, "packing_specs"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(_documents(spark, folder), table(spark, folder, "eval_items"))


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.without_leaks(_documents(spark, folder), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(_documents(spark, folder), table(spark, folder, "reading_labels")).select("doc_id", "level")


def p10_profile(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_profile(_documents(spark, folder), table(spark, folder, "reading_labels"))


def p2_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files told per repository and language: none is lost on the way."""
    return p2_rates(spark, folder).select("repo_name", "lang", "files")


def p3_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files labelled per repository."""
    return p3_labels(spark, folder).groupBy("repo_name").agg(F.count("label").alias("files"))


def p4_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """Every issue, reported once or often, with its survivor."""
    return p4_issues(spark, folder).select("group_id", "survivor_id")


def p8_placed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with text in containers of each size, its pieces without gap or overlap and none above the size."""
    packed = p8_packed(spark, folder).join(table(spark, folder, "packing_specs").select("spec_id", "capacity_tokens"), "spec_id")
    found = packed.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("total"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.max("piece").alias("last"), F.max(F.col("tokens") > F.col("capacity_tokens")).alias("over"))
    return found.select("spec_id", "doc_id", ((F.col("total") == F.col("end")) & (F.col("pieces") == F.col("last") + 1) & ~F.col("over")).alias("whole"))


def p9_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of which something was cut."""
    return p9_clean(spark, folder).where("removed_spans > 0").select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_rebuilt": p1_rebuilt, "p1_overlong": p1_overlong, "p2_found": p2_found, "p2_rates": p2_rates, "p2_files": p2_files, "p3_found": p3_found, "p3_labels": p3_labels, "p3_files": p3_files, "p4_found": p4_found, "p4_issues": p4_issues, "p4_survivors": p4_survivors, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_masked": p6_masked, "p9_found": p9_found, "p9_clean": p9_clean, "p9_cleaned": p9_cleaned, "p8_packed": p8_packed, "p8_fill": p8_fill, "p8_placed": p8_placed, "p10_found": p10_found, "p10_profile": p10_profile}

_quoted = lambda values: ", ".join("'" + v + "'" for v in values)

_NEAR = """w AS (SELECT chunk_id, regexp_extract_all(content, '[A-Za-z0-9_]+') AS words FROM chunks WHERE content IS NOT NULL),
g AS (SELECT chunk_id, list_distinct(list_transform(generate_series(1, len(words) - 2), lambda i: array_to_string(words[i:i + 2], ' '))) AS grams FROM w WHERE len(words) >= 30),
c AS (SELECT sha256(array_to_string(list_sort(grams), '|')) AS class, any_value(grams) AS grams, list(chunk_id) AS ids FROM g GROUP BY 1),
t AS (SELECT class, len(grams) AS n, unnest(grams) AS gram FROM c), f AS (SELECT gram, count(*) AS df FROM t GROUP BY 1),
p AS (SELECT class, n, gram, row_number() OVER (PARTITION BY class ORDER BY df, gram) AS at FROM t JOIN f USING (gram)),
k AS (SELECT DISTINCT a.class AS a, b.class AS b FROM p a JOIN p b ON a.gram = b.gram AND a.class < b.class AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) WHERE a.at <= a.n - (7 * a.n + 9) // 10 + 1 AND b.at <= b.n - (7 * b.n + 9) // 10 + 1),
l AS (SELECT x.ids AS xs, y.ids AS ys, len(list_intersect(x.grams, y.grams)) AS shared, len(x.grams) + len(y.grams) AS total FROM k JOIN c x ON x.class = k.a JOIN c y ON y.class = k.b),
n1 AS (SELECT unnest(xs) AS x, ys FROM l WHERE 10 * shared >= 7 * (total - shared)), n2 AS (SELECT x, unnest(ys) AS y FROM n1),
o1 AS (SELECT unnest(ids) AS x, ids FROM c WHERE len(ids) > 1), o2 AS (SELECT x, unnest(ids) AS y FROM o1),
pairs AS (SELECT least(x, y) AS chunk_id_a, greatest(x, y) AS chunk_id_b FROM n2 UNION ALL SELECT x, y FROM o2 WHERE x < y)"""

_ISSUES = f"""
WITH r AS (SELECT review_id, min(repo_name) AS repo FROM reviews GROUP BY 1),
a AS (SELECT f.*, regexp_replace(regexp_replace(replace(trim(file_path), '\\', '/'), '/(\\./)*/*', '/', 'g'), '^(\\./|/)+', '') AS p, coalesce(repo, '~~') AS repo FROM findings f LEFT JOIN r USING (review_id)),
b AS (SELECT *, regexp_replace(CASE WHEN starts_with(p, repo || '/') THEN substr(p, length(repo) + 2) ELSE p END, '^[ab]/', '') AS path, lower(trim(category)) AS kind FROM a),
c AS (SELECT finding_id, review_id, path, line_number, kind, created_at,
  CASE WHEN upper(trim(severity)) IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO') THEN upper(trim(severity)) END AS s,
  CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS conf,
  {", ".join(f"(description IS NOT NULL AND lower(trim({t})) NOT IN ({_quoted(survivors.NOTHING)}))::INT AS u{i}".replace("description IS", f"{t} IS") for i, t in enumerate(survivors.TEXTS))}
  FROM b WHERE review_id IS NOT NULL AND line_number >= 1 AND path <> '' AND kind <> ''),
d AS (SELECT *, row_number() OVER w AS nth, count(*) OVER g AS n, min(finding_id) OVER g AS group_id FROM c
  WINDOW g AS (PARTITION BY review_id, path, line_number, kind),
  w AS (PARTITION BY review_id, path, line_number, kind ORDER BY (s IS NOT NULL)::INT + u0 + u1 + u2 + (conf IS NOT NULL)::INT DESC, conf DESC NULLS LAST,
    CASE s WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END DESC, created_at DESC NULLS LAST, finding_id))
"""
_LANG = "lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1))"

_LEAKED = """
WITH RECURSIVE clean AS (SELECT item_id AS id, 'i' AS side, text FROM eval_items UNION ALL SELECT doc_id, 'd', text FROM documents),
w AS (SELECT side, id, list_transform(regexp_extract_all(regexp_replace(text, '[\\x{ad}\\x{200b}-\\x{200f}\\x{2060}-\\x{2064}\\x{feff}]', '', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x)) AS words FROM clean),
g AS (SELECT side, id, unnest(list_transform(generate_series(1, len(words) - 11), lambda i: array_to_string(words[i:i + 11], ' '))) AS gram FROM w WHERE len(words) >= 12)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.gram = i.gram WHERE d.side = 'd' AND i.side = 'i'"""

SQL = {
    "p5_found": f"WITH {_NEAR} SELECT * FROM pairs",
    "p5_groups": f"""WITH RECURSIVE {_NEAR}, e AS (SELECT chunk_id_a AS x, chunk_id_b AS y FROM pairs UNION ALL SELECT chunk_id_b, chunk_id_a FROM pairs),
walk AS (SELECT chunk_id AS x, chunk_id AS root FROM g UNION SELECT e.y, walk.root FROM walk JOIN e ON e.x = walk.x), r AS (SELECT x, min(root) AS group_id FROM walk GROUP BY x),
s AS (SELECT unnest(ids) AS x, len(ids) AS class_size FROM c), d AS (SELECT x, count(*) AS links FROM e GROUP BY x)
SELECT r.x AS chunk_id, group_id, class_size, coalesce(links, 0) AS links FROM r JOIN s USING (x) LEFT JOIN d USING (x)""",
    "p1_found": """
SELECT c.chunk_id FROM chunks c JOIN size_limits s ON lower(trim(regexp_replace(c.chunk_type, '\\s+', ' ', 'g'))) = lower(trim(s.chunk_type))
WHERE length(c.content) > s.max_chars""",
    "p1_rebuilt": """
SELECT c.chunk_id, TRUE AS cut, sha256(c.content) AS text_hash FROM chunks c JOIN size_limits s ON lower(trim(regexp_replace(c.chunk_type, '\\s+', ' ', 'g'))) = lower(trim(s.chunk_type))
WHERE length(c.content) > s.max_chars""",
    "p1_overlong": """
SELECT lower(trim(s.chunk_type)) AS kind, count(*) AS items, 0::BIGINT AS overlong FROM chunks c JOIN size_limits s ON lower(trim(regexp_replace(c.chunk_type, '\\s+', ' ', 'g'))) = lower(trim(s.chunk_type))
WHERE length(c.content) > s.max_chars GROUP BY 1""",
    "p4_found": _ISSUES + "SELECT group_id, finding_id AS survivor_id FROM d WHERE n > 1 AND nth = 1",
    "p4_survivors": _ISSUES + "SELECT group_id, finding_id AS survivor_id FROM d WHERE nth = 1 UNION ALL SELECT finding_id, finding_id FROM findings WHERE finding_id NOT IN (SELECT finding_id FROM c)",
    "p2_files": f"SELECT repo_name, {_LANG} AS lang, count(DISTINCT file_path) AS files FROM chunks WHERE {_LANG} IN ('py', 'js', 'jsx', 'ts', 'tsx', 'go', 'rs') GROUP BY ALL",
    "p3_files": f"SELECT repo_name, count(DISTINCT file_path) AS files FROM chunks WHERE {_LANG} IN ('py', 'js', 'jsx', 'ts', 'tsx', 'go', 'rs') GROUP BY ALL",
    "p8_placed": "SELECT spec_id, doc_id, TRUE AS whole FROM documents CROSS JOIN packing_specs WHERE length(text) > 0",
"p9_found": _LEAKED,
    "p9_cleaned": f"SELECT DISTINCT doc_id FROM ({_LEAKED})",
}
