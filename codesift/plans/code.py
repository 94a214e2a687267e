"""Queries on source lines, structure, task graphs, model answers and streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.operators import chain, chunking, dag, events, rules, trees
from codesift.plans import diffs as diff_plans
from codesift.plans import trees as tree_plans
from codesift.sources.tables import table
from codesift.streaming import events as streams


def rule_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and calls that break a rule."""
    return _scanned(table(spark, folder, "chunks"))


def rule_scan_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """The same over the snippets of the scanner's own findings, in which most rules hit."""
    rows = table(spark, folder, "static_findings")
    return _scanned(rows.select(F.col("static_id").alias("chunk_id"), "repo_name", F.col("file").alias("file_path"), F.col("matched_code").alias("content"))).withColumnRenamed("chunk_id", "static_id")


def _scanned(chunks: DataFrame) -> DataFrame:
    return rules.scan_chunks(chunks).withColumn("line_no", F.col("line_no").cast("bigint"))


def rule_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rule_scan(spark, folder).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("chunk_id").alias("chunks"))


def static_findings_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Scanner findings without those repeated under a new id."""
    columns = ["rule_id", "repo_name", "file", "line", "message", "matched_code"]
    return table(spark, folder, "static_findings").groupBy(*columns).agg(F.min("static_id").alias("static_id")).select("static_id")


def static_severity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "static_findings").groupBy("rule_id", F.upper(F.trim("severity")).alias("severity")).agg(F.count(F.lit(1)).alias("findings"))


# Heads of lines by language and kind; patterns stay within what RE2 also reads.
HEADS = (
    ("python", "function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)"),
    ("python", "type", r"^\s*class\s+([A-Za-z_]\w*)"),
    ("javascript", "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function(?:\s+|\s*\*\s*)([A-Za-z_$][\w$]*)"),
    ("javascript", "arrow", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::.*[^=!<>])?=\s*(?:async\b\s*)?(?:<[^()]*>\s*)?(?:\([^)]*\)\s*(?::[^=]+)?|[A-Za-z_$][\w$]*\s*)=>"),
    ("javascript", "type", r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:const\s+enum|class|interface|type|enum)\s+([A-Za-z_$][\w$]*)"),
    ("go", "function", r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*[\[(]"),
    ("go", "type", r"^\s*type\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+(?:struct|interface)\b"),
    ("rust", "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+([A-Za-z_]\w*)"),
    ("rust", "type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:struct|enum|trait|union)\s+([A-Za-z_]\w*)"),
    ("rust", "impl", r"^\s*(?:unsafe\s+)?impl(?:\s*<.*?>)?\s+!?(?:\w+::)*([A-Za-z_]\w*)"),
)


def found_heads(lines: DataFrame) -> DataFrame:
    """(repo_name, language, kind, name) of each definition by the heads of lines."""
    heads = F.array(*[F.when((F.col("language") == language) & F.col("line").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", pattern, 1).alias("name"))) for language, kind, pattern in HEADS])
    return lines.select("repo_name", "language", F.explode(F.filter(heads, lambda h: h.isNotNull())).alias("head")).select("repo_name", "language", "head.*")


def count_heads(lines: DataFrame, *keys: str) -> DataFrame:
    return found_heads(lines).groupBy(*(keys or ("repo_name", "language", "kind"))).agg(F.count(F.lit(1)).alias("heads"), F.countDistinct("name").alias("names"))


def definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Functions, types and impls per repository and language."""
    return count_heads(rules.code_lines(table(spark, folder, "chunks")), "repo_name", "language")


def definitions_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    """The same, told apart by kind."""
    return count_heads(rules.code_lines(table(spark, folder, "chunks")), "repo_name", "language", "kind")


def structural_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_files(trees.file_texts(table(spark, folder, "chunks")))


def structural_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each file that hold something and lie in a chunk: all of them do."""
    files = trees.file_texts(table(spark, folder, "chunks"))
    lines = files.select("repo_name", "file_path", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where("trim(line) <> ''").select("repo_name", "file_path", (F.col("at") + 1).alias("at"))
    spans = chunking.chunk_files(files).select("repo_name", "file_path", F.explode(F.sequence("start_line", "end_line")).alias("at")).distinct()
    return lines.join(spans, ["repo_name", "file_path", "at"], "left_semi").groupBy("repo_name", "file_path").agg(F.count(F.lit(1)).alias("lines"))


def function_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.measure_functions(trees.file_texts(table(spark, folder, "chunks")))


def complexity_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = function_metrics(spark, folder)
    return rows.groupBy("repo_name").agg(F.count(F.lit(1)).alias("functions"), F.max("complexity").alias("most"), F.sum("complexity").alias("total"), F.count_if(F.col("nesting") > 4).alias("deep"))


def diff_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """Per message: functions in the added lines, their complexity and nesting, who calls what, and the rules that the lines break."""
    added = diff_plans.diff_added_source(spark, folder).select(F.col("msg_id").cast("string").alias("repo_name"), "file_path", F.col("source").alias("text"))
    measured = chunking.measure_functions(added)
    last = F.max_by("calls", F.struct("file_path", "line"))
    graph = measured.groupBy("repo_name", "name").agg(last.alias("calls")).groupBy("repo_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "calls")))).alias("call_graph"))
    rolled = measured.groupBy("repo_name").agg(F.count(F.lit(1)).alias("functions"), F.max("complexity").alias("most"), F.sum("complexity").alias("total"), F.count_if(F.col("nesting") > 4).alias("deep"))
    broken = rules.scan_chunks(added.select(F.col("repo_name").alias("chunk_id"), "repo_name", "file_path", F.col("text").alias("content"))).groupBy(F.col("chunk_id").alias("repo_name")).agg(F.count(F.lit(1)).alias("findings"))
    out = added.select("repo_name").distinct().join(rolled, "repo_name", "left").join(graph, "repo_name", "left").join(broken, "repo_name", "left")
    return out.select(F.col("repo_name").cast("bigint").alias("msg_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("functions", "most", "total", "deep", "findings")], "call_graph")


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The task graph of every review: fetch, the agents that found something, then rewrite and publish behind each agent, and the aggregate.

    States follow the review: of one that failed or goes on, agents with an
    odd number of findings failed or wait.
    """
    reviews = table(spark, folder, "reviews").select("review_id", "status")
    agents = table(spark, folder, "findings").where("review_id IS NOT NULL AND agent IS NOT NULL").groupBy("review_id", "agent").agg(F.count(F.lit(1)).alias("n")).join(reviews, "review_id")
    name = lambda *parts: F.concat_ws(":", "review_id", *parts)
    odd = (F.col("status") != "completed") & (F.col("n") % 2 == 1)
    state = F.when(odd, F.when(F.col("status") == "failed", "failed").otherwise("pending")).otherwise("completed")
    own = agents.select(name("agent").alias("id"), F.lit("reviewer").alias("role"), state.alias("status"))
    after = agents.select(F.explode(F.array(*[name("agent", F.lit(step)) for step in ("rewrite", "publish")])).alias("id"), F.lit("writer").alias("role"), F.lit("pending").alias("status"))
    ends = reviews.select(F.explode(F.array(F.struct(name(F.lit("fetch")).alias("id"), F.lit("fetcher").alias("role"), F.lit("completed").alias("status")), F.struct(name(F.lit("aggregate")).alias("id"), F.lit("aggregator").alias("role"), F.lit("pending").alias("status")))).alias("t")).select("t.*")
    edge = lambda src, dst: F.struct(src.alias("src"), dst.alias("dst"))
    me = name("agent")
    edges = agents.select(F.explode(F.array(edge(name(F.lit("fetch")), me), edge(me, name("agent", F.lit("rewrite"))), edge(name("agent", F.lit("rewrite")), name("agent", F.lit("publish"))), edge(me, name(F.lit("aggregate"))))).alias("e")).select("e.*")
    return own.unionByName(after).unionByName(ends), edges


def dag_ready(spark: SparkSession, folder: str) -> DataFrame:
    return dag.ready(*_graph(spark, folder))


def dag_levels(spark: SparkSession, folder: str) -> DataFrame:
    return dag.levels(*_graph(spark, folder))


def dag_skipped(spark: SparkSession, folder: str) -> DataFrame:
    return dag.skipped_by_failure(*_graph(spark, folder), rounds=8)


def dag_progress(spark: SparkSession, folder: str) -> DataFrame:
    return dag.progress(_graph(spark, folder)[0])


def answers_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """JSON answers in code fences, stripped and read by schema."""
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    rows = table(spark, folder, "events").select("event_id", chain.parsed(fenced, "k BIGINT")["k"].alias("k"))
    return rows.where("k IS NOT NULL")


def prompts_rendered(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pull_requests")
    text = chain.render("Review {title} of {repo}.\n{body}", {"title": F.col("title"), "repo": F.col("repo_name"), "body": F.col("body")})
    return rows.select("msg_id", F.sha2(text.cast("binary"), 256).alias("prompt_hash"))


def _echo(prompt: str) -> str:
    return json.dumps({"length": len(prompt)})


def _is_json(answer: str) -> bool:
    try:
        return isinstance(json.loads(answer), dict)
    except ValueError:
        return False


def reasoning_chain(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pull_requests").select(F.col("msg_id").alias("id"), F.col("diff").alias("text"))
    steps = [("analyze", "Analyze {text}"), ("generate", "Report on {analyze}"), ("critique", "Check {generate}"), ("refine", "Improve {generate} by {critique}")]
    return chain.run_chain(rows, steps, _echo, _is_json)


def signatures_verified(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pull_requests").select("msg_id", "diff", chain.signature("shared")(F.col("diff")).alias("given"))
    return rows.select("msg_id", chain.verified("shared")(F.col("diff"), F.col("given")).alias("ok")).groupBy("ok").agg(F.count(F.lit(1)).alias("messages"))


def point_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").select("repo_name", "file_path").distinct()
    return rows.select("repo_name", "file_path", chain.name_uuid(F.concat_ws(":", "repo_name", "file_path", F.lit("cg"))).alias("id"))


def stream_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    stream = streams.first_within(streams.read_table(spark, folder, "events", streams.EVENTS), ["event_id"])
    return streams.run_to_end(stream, "dedup", "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total"))


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    stream = events.per_window(streams.timed(streams.read_table(spark, folder, "events", streams.EVENTS), "2 hours"), "ts", "1 hour", None, ["event_type"])
    return streams.run_to_end(stream, "windows", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


def _sql_rules() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    met = lambda r, text: " AND ".join([f"regexp_matches({text}, {quoted(r.pattern)})" if r.pattern else "TRUE", *([f"NOT regexp_matches({text}, {quoted(r.unless)})"] if r.unless else [])])
    parts = []
    for r in rules.RULES:
        head = f"'{r.rule_id}' AS rule_id, '{r.severity}' AS severity, '{r.category}' AS category"
        if not r.call:
            parts.append(f"SELECT chunk_id, line_no, {head} FROM lines WHERE language = '{r.language}' AND {met(r, 'line')}")
            continue
        call = f"regexp_extract(parts[n + 1], {quoted(rules.ARGUMENTS)})"
        before = "array_to_string(parts[1:n], '')"
        parts.append(
            f"SELECT DISTINCT chunk_id, length({before}) - length(replace({before}, chr(10), '')) + 1 AS line_no, {head} FROM (SELECT chunk_id, parts, unnest(range(1, len(parts))) AS n FROM "
            f"(SELECT chunk_id, string_split(regexp_replace(content, {quoted('(' + r.call + ')')}, chr(1) || '\\1', 'g'), chr(1)) AS parts FROM texts WHERE language = '{r.language}')) "
            f"WHERE {met(r, call)} AND NOT regexp_matches(string_split({before}, chr(10))[-1], {quoted(rules.COMMENT)})"
        )
    return " UNION ALL ".join(parts)


def _sql_heads() -> str:
    return " UNION ALL ".join(f"SELECT repo_name, language, '{kind}' AS kind, regexp_extract(line, '{pattern}', 1) AS name FROM lines WHERE language = '{language}' AND regexp_matches(line, '{pattern}')" for language, kind, pattern in HEADS)


_CODE = """WITH texts AS (SELECT chunk_id, repo_name, content, CASE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'javascript' WHEN 'tsx' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' END AS language FROM chunks WHERE content IS NOT NULL),
l AS (SELECT chunk_id, repo_name, language, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM texts),
lines AS (SELECT * FROM l WHERE language IS NOT NULL AND NOT regexp_matches(line, '^\\s*(?:#|//|\\*|/\\*)'))"""
_VALUES = """WITH agents AS (SELECT f.review_id, agent, count(*) AS n, any_value(r.status) AS status FROM findings f JOIN reviews r ON r.review_id = f.review_id WHERE agent IS NOT NULL GROUP BY ALL),
tasks AS (SELECT review_id || ':' || agent AS id, 'reviewer' AS role, CASE WHEN status <> 'completed' AND n % 2 = 1 THEN CASE WHEN status = 'failed' THEN 'failed' ELSE 'pending' END ELSE 'completed' END AS status FROM agents
  UNION ALL SELECT review_id || ':' || agent || ':' || unnest(['rewrite', 'publish']), 'writer', 'pending' FROM agents UNION ALL SELECT review_id || ':fetch', 'fetcher', 'completed' FROM reviews UNION ALL SELECT review_id || ':aggregate', 'aggregator', 'pending' FROM reviews),
edges AS (SELECT review_id || ':fetch' AS src, review_id || ':' || agent AS dst FROM agents UNION ALL SELECT review_id || ':' || agent, review_id || ':' || agent || ':rewrite' FROM agents UNION ALL SELECT review_id || ':' || agent || ':rewrite', review_id || ':' || agent || ':publish' FROM agents UNION ALL SELECT review_id || ':' || agent, review_id || ':aggregate' FROM agents)"""

QUERIES = {
    q.__name__: q
    for q in (rule_scan, rule_scan_snippets, rule_counts, static_findings_distinct, static_severity, definitions, definitions_by_kind, structural_chunks, structural_cover, function_metrics, complexity_summary, diff_analysis, dag_ready, dag_levels, dag_skipped, dag_progress, answers_parsed, prompts_rendered, reasoning_chain, signatures_verified, point_ids, stream_deduplicated, stream_windows)
}
SQL = {
    "rule_scan": f"{_CODE} {_sql_rules()}",
    "rule_scan_snippets": f"{_CODE} {_sql_rules()}".replace("chunk_id, repo_name, content, CASE", "static_id AS chunk_id, repo_name, matched_code AS content, CASE").replace("file_path", "file").replace("FROM chunks WHERE content", "FROM static_findings WHERE matched_code").replace("SELECT chunk_id, line_no, '", "SELECT chunk_id AS static_id, line_no, '").replace("SELECT DISTINCT chunk_id,", "SELECT DISTINCT chunk_id AS static_id,"),
    "rule_counts": f"{_CODE}, hits AS ({_sql_rules()}) SELECT rule_id, severity, count(*) AS lines, count(DISTINCT chunk_id) AS chunks FROM hits GROUP BY ALL",
    "static_findings_distinct": "SELECT min(static_id) AS static_id FROM static_findings GROUP BY rule_id, repo_name, file, line, message, matched_code",
    "static_severity": "SELECT rule_id, upper(trim(severity)) AS severity, count(*) AS findings FROM static_findings GROUP BY ALL",
    "definitions": f"{_CODE}, found AS ({_sql_heads()}) SELECT repo_name, language, count(*) AS heads, count(DISTINCT name) AS names FROM found GROUP BY ALL",
    "definitions_by_kind": f"{_CODE}, found AS ({_sql_heads()}) SELECT repo_name, language, kind, count(*) AS heads, count(DISTINCT name) AS names FROM found GROUP BY ALL",
    "dag_ready": _VALUES + " SELECT id FROM tasks t WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM edges e JOIN tasks d ON d.id = e.src WHERE e.dst = t.id AND d.status NOT IN ('completed', 'failed', 'skipped'))",
    "dag_levels": _VALUES.replace("WITH agents", "WITH RECURSIVE agents") + ", w AS (SELECT id, 0 AS level FROM tasks WHERE id NOT IN (SELECT dst FROM edges) UNION SELECT dst, level + 1 FROM w JOIN edges ON src = id) SELECT id, max(level) AS level FROM w GROUP BY 1",
    "dag_skipped": _VALUES.replace("WITH agents", "WITH RECURSIVE agents") + ", w AS (SELECT id FROM tasks WHERE status IN ('failed', 'skipped') UNION SELECT t.id FROM w JOIN edges ON src = w.id JOIN tasks t ON t.id = dst WHERE t.status = 'pending' AND t.role <> 'aggregator') SELECT id FROM w JOIN tasks USING (id) WHERE status = 'pending'",
    "dag_progress": _VALUES + " SELECT count(*) AS tasks, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed, round(100 * count(*) FILTER (status IN ('completed', 'failed', 'skipped')) / count(*), 1) AS percent FROM tasks",
    "answers_parsed": "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events WHERE (props ->> '$.k') IS NOT NULL",
    "prompts_rendered": "SELECT msg_id, sha256('Review ' || coalesce(title, '{unavailable: title}') || ' of ' || coalesce(repo_name, '{unavailable: repo}') || '.' || chr(10) || coalesce(body, '{unavailable: body}')) AS prompt_hash FROM pull_requests",
    "stream_deduplicated": "SELECT event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "stream_windows": "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "structural_cover": "WITH" + tree_plans._TEXTS + " SELECT repo_name, file_path, count(*) AS lines FROM (SELECT repo_name, file_path, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE trim(line, ' ') <> '' GROUP BY ALL",
    "signatures_verified": "SELECT diff IS NOT NULL AS ok, count(*) AS messages FROM pull_requests GROUP BY 1",
    "reasoning_chain": """WITH a AS (SELECT msg_id, '{"length": ' || length('Analyze ' || coalesce(diff, '')) || '}' AS a FROM pull_requests), g AS (SELECT *, '{"length": ' || length('Report on ' || a) || '}' AS g FROM a), c AS (SELECT *, '{"length": ' || length('Check ' || g) || '}' AS c FROM g)
SELECT msg_id AS id, 4 AS steps, '{"length": ' || length('Improve ' || g || ' by ' || c) || '}' AS answer, TRUE AS valid FROM c""",
    "point_ids": """WITH f AS (SELECT DISTINCT repo_name, file_path FROM chunks), h AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat_ws(':', repo_name, file_path, 'cg'))) AS h FROM f)
SELECT repo_name, file_path, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', h[17:17])::INT, 1) || h[18:20] || '-' || h[21:32] AS id FROM h""",
}
