"""Queries on rendered texts, index runs, intake and the remaining parts of a review."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.operators import chain, events, indexing, rendering, search, trees
from codesift.operators.delivery import canonical_identifier
from codesift.plans import diffs as diff_plans
from codesift.plans import events as event_plans
from codesift.plans import search as search_plans
from codesift.plans import trees as tree_plans
from codesift.sources import snapshots
from codesift.sources.tables import table

SMALL = 20  # lines up to which ``numbered_regions`` shows a file whole


def _hashed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.sha2(F.col(column).cast("binary"), 256))


def review_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return rendering.verdicts(table(spark, folder, "findings"), table(spark, folder, "reviews"))


def finding_sections(spark: SparkSession, folder: str) -> DataFrame:
    return _hashed(rendering.sections(table(spark, folder, "findings").where("review_id IS NOT NULL")), "section")


def review_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return _hashed(rendering.summaries(table(spark, folder, "findings"), table(spark, folder, "reviews")), "summary")


def _hunks(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "pull_requests").select("msg_id", "repo_name")
    return diff_plans.diff_hunks(spark, folder).join(names, "msg_id").select("repo_name", "file_path", "first", "last").distinct()


def numbered_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Every file with the numbers of its lines, as models are shown it."""
    files = trees.file_texts(table(spark, folder, "chunks")).select("repo_name", "file_path", "text")
    return _hashed(rendering.numbered_source(files, _hunks(spark, folder)), "shown")


def numbered_regions(spark: SparkSession, folder: str) -> DataFrame:
    """The same, but files of more than twenty lines by their changed regions and three lines around."""
    files = trees.file_texts(table(spark, folder, "chunks")).select("repo_name", "file_path", "text")
    return _hashed(rendering.numbered_source(files, _hunks(spark, folder), SMALL, 3), "shown")


def change_context(spark: SparkSession, folder: str) -> DataFrame:
    """What models are told about other files beside a change."""
    changed = table(spark, folder, "pull_requests").select("repo_name", F.explode("changed_files").alias("file_path"))
    return rendering.cross_file_context(changed, table(spark, folder, "chunks"))


def structure_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _hashed(rendering.structure_text(search_plans.code_graphs(spark, folder)), "text")


def deliveries_routed(spark: SparkSession, folder: str) -> DataFrame:
    """The queue as deliveries of several events: accepted, duplicate, ignored or rejected."""
    kind = F.pmod("msg_id", F.lit(4))
    rows = table(spark, folder, "pull_requests").select(
        F.col("msg_id").alias("delivery_id"), canonical_identifier(F.col("correlation_id")).alias("key"), F.col("received_at").alias("at"), (F.pmod("msg_id", F.lit(11)) != 0).alias("valid"),
        F.when(kind == 0, "issue_comment").otherwise("pull_request").alias("event"), F.when(kind == 0, "created").when(kind == 3, "closed").when(kind == 2, "synchronize").otherwise("opened").alias("action"), F.col("body").alias("comment"), (F.pmod("number", F.lit(5)) != 0).alias("on_pull"),
    )
    return events.routed(rows, "the").select("delivery_id", "status")


def failures_classified(spark: SparkSession, folder: str) -> DataFrame:
    """Failures worth another attempt and not, by name and answer."""
    names = F.array(*[F.lit(n) for n in (*events.PERMANENT_ERRORS, "TimeoutError", "ConnectionError")])
    failed = table(spark, folder, "events").where("event_type = 'error'")
    rows = failed.select(F.when(F.col("event_id") % 3 == 0, F.element_at(names, (F.col("event_id") % 8 + 1).cast("int"))).otherwise("HTTPError").alias("error"), F.when(F.col("event_id") % 3 != 0, 400 + F.col("event_id") % 30).alias("code"))
    return rows.groupBy("error", events.is_permanent(F.col("error"), F.col("code")).alias("permanent")).agg(F.count(F.lit(1)).alias("failures"))


def _letters(spark: SparkSession, folder: str) -> DataFrame:
    """The scanner's findings as dead letters, a ninth of them unreadable."""
    rows = table(spark, folder, "static_findings")
    text = F.when(F.col("static_id") % 9 == 0, F.concat(F.lit("lost: "), F.coalesce("rule_id", F.lit("")))).otherwise(F.to_json(F.struct(F.col("repo_name").alias("repo"), F.col("line").alias("number"))))
    return events.parsed_letters(rows.select("static_id", text.alias("letter")), "repo STRING, number INT")


def dead_letters_by_repo(spark: SparkSession, folder: str) -> DataFrame:
    """Dead letters per repository of their message; those that are no JSON in a place of their own."""
    rows = _letters(spark, folder)
    return rows.groupBy(F.when(F.col("body").isNull(), "unreadable").otherwise(F.coalesce("body.repo", F.lit("unknown"))).alias("repo")).agg(F.count(F.lit(1)).alias("letters"))


def dead_letters_replayed(spark: SparkSession, folder: str) -> DataFrame:
    """What of the queue is sent again, and what stays, when all or only the eleventh of the latest is replayed."""
    rows, order = _letters(spark, folder), [F.col("static_id").desc()]
    found = None
    for index in (None, 10):
        sent, left = events.replayed(rows, order, "static_id", "body", index)
        for state, part in (("sent", sent), ("left", left)):
            counted = part.agg(F.count(F.lit(1)).alias("letters"), F.sum("static_id").alias("ids")).select(F.lit("all" if index is None else "one").alias("replay"), F.lit(state).alias("state"), "letters", "ids")
            found = counted if found is None else found.unionByName(counted)
    return found


def _run(spark: SparkSession, folder: str) -> indexing.IndexRun:
    """An index run: repositories with a source are new, those of the others known, stale where a chunk has no time."""
    chunks = table(spark, folder, "chunks")
    sources = tree_plans._sources(spark, folder)
    files = trees.file_texts(chunks).select("repo_name", "file_path", "text")
    stale = chunks.where("indexed_at IS NULL").select("repo_name", "file_path").distinct().withColumn("stale", F.lit(True))
    known = trees.leaf_hashes(files).join(sources.select("repo_name"), "repo_name", "left_anti").join(stale, ["repo_name", "file_path"], "left")
    known = known.select("repo_name", "file_path", F.when(F.col("stale"), "stale").otherwise(F.col("hash")).alias("hash"))
    parts = chunks.groupBy("repo_name", "file_path", "chunk_index").agg(F.max("content").alias("content"))
    stored = lambda changed: parts.join(changed.select("repo_name", "file_path"), ["repo_name", "file_path"], "left_semi")
    return indexing.run_index(files, known, sources, search_plans._cache(spark, folder), stored, most_files=40)


def index_run(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of a run over all repositories."""
    return _run(spark, folder).stats


def index_applied(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks per repository after the run, and how many of them were copied."""
    chunks = table(spark, folder, "chunks")
    index = chunks.groupBy("repo_name", "file_path", "chunk_index").agg(F.max("content").alias("content")).withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    index = index.join(tree_plans._sources(spark, folder).select("repo_name"), "repo_name", "left_anti")
    after = indexing.applied(index, _run(spark, folder))
    return after.groupBy("repo_name").agg(F.count(F.lit(1)).alias("chunks"), F.count("copied_from").alias("copied"))


def embed_missing_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that are embedded: each once, and only those that the cache lacks."""
    return search.embed_missing(search_plans._hashed(spark, folder), search_plans._cache(spark, folder)).select("content_hash", (F.size("embedding") > 0).alias("embedded"))


def cache_unexpired(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of a cache whose entries run out seven days after they were written, at the time of the last writing."""
    chunks = search_plans._hashed(spark, folder)
    cache = chunks.groupBy("content_hash").agg((F.max("indexed_at") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    now = chunks.agg(F.max(F.unix_micros("indexed_at"))).first()[0] or 0
    looked = search.cache_lookup(chunks, cache, F.timestamp_micros(F.lit(now)))
    return looked.groupBy("repo_name").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def cascade_deleted(spark: SparkSession, folder: str) -> DataFrame:
    """The findings that go with the reviews that did not complete."""
    gone = table(spark, folder, "reviews").where("status <> 'completed'").select("review_id")
    return snapshots.cascaded(gone, table(spark, folder, "findings"), "review_id").select("finding_id")


def contents_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Contents as they are fetched, in base64 with line ends, decoded."""
    wire = F.regexp_replace(F.base64(F.col("content").cast("binary")), "(.{60})", "$1\n")
    rows = table(spark, folder, "chunks").where("content IS NOT NULL").select("chunk_id", wire.alias("wire"))
    return rows.select("chunk_id", F.sha2(snapshots.decoded(F.col("wire")).cast("binary"), 256).alias("text_hash"))


def chunk_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """What is stored beside the vector of a chunk."""
    rows = table(spark, folder, "chunks").where("content_hash IS NOT NULL")
    return snapshots.payloads(rows, 300).select("content_hash", "file_path", "repo_name", "symbol_name", "start_line", F.size("symbols_called").alias("calls"), F.length("content").alias("size"))


def called_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names called, by their last segment, where that is an identifier."""
    rows = table(spark, folder, "chunks").select(F.explode("symbols_called").alias("call"))
    return rows.select(search.last_segment(F.col("call")).alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("calls"))


def chunks_matching(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of a type that call one of some names."""
    rows = table(spark, folder, "chunks").withColumn("kind", F.lower(F.trim("chunk_type")))
    names = [r[0] for r in called_names(spark, folder).orderBy(F.col("calls").desc(), "name").limit(5).collect()]
    return snapshots.matching(rows, {"kind": "function"}, {"symbols_called": names}).select("chunk_id")


def index_states(spark: SparkSession, folder: str) -> DataFrame:
    """Every repository with chunks: none, fresh or stale by its last run."""
    runs = event_plans.latest_runs(spark, folder).select("repo_name", "state")
    repos = table(spark, folder, "chunks").select("repo_name").distinct()
    return repos.join(runs, "repo_name", "left").select("repo_name", F.coalesce("state", F.lit("none")).alias("state"))


def answers_or_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Answers by their schema, or the raw text where they are none."""
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("I think: "), "props")).otherwise(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    rows = table(spark, folder, "events").select("event_id", chain.parsed_or_raw(text, "k BIGINT").alias("a"))
    return rows.select("event_id", F.col("a.value.k").alias("k"), F.col("a.raw_text").alias("raw_text"))


def prompt_templates(spark: SparkSession, folder: str) -> DataFrame:
    return chain.templates(spark).select("agent", "step", "temperature", (F.length("template") > 0).alias("written"))


def _odd(text: str) -> str:
    if len(text) % 2 == 0:
        raise ValueError("even")
    return json.dumps({"length": len(text)})


def agent_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Each diff by its files; a file whose run fails is left out, and where all fail the whole diff is run."""
    parts = diff_plans.diff_by_file(spark, folder).select(F.col("msg_id").alias("id"), "file_path", "patch")
    whole = table(spark, folder, "pull_requests").where("diff IS NOT NULL").select(F.col("msg_id").alias("id"), F.concat("diff", F.lit(" "), F.repeat(F.lit("x"), F.length("diff") % 2)).alias("text"))
    return chain.run_per_file(parts, whole, _odd).groupBy("id", "mode").agg(F.count(F.lit(1)).alias("answers"), F.count_if("failed").alias("failed"))


_NAMED = "named AS (SELECT *, CASE WHEN upper(trim(severity)) IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO') THEN upper(trim(severity)) ELSE 'INFO' END AS sev FROM findings), ranked AS (SELECT *, CASE sev WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END AS rank FROM named WHERE review_id IS NOT NULL)"
_SECTIONS = _NAMED + """, items AS (SELECT review_id, agent, rank, sev, finding_id, '- `' || coalesce(file_path, '?') || ':' || coalesce(line_number::VARCHAR, '?') || '` — ' || coalesce(description, '') ||
  CASE WHEN length(current_code) > 0 AND length(suggested_fix) > 0 THEN chr(10) || '```diff' || chr(10) || '- ' || trim(current_code) || chr(10) || '+ ' || trim(suggested_fix) || chr(10) || '```' ELSE '' END AS line FROM ranked),
blocks AS (SELECT review_id, agent, rank, count(*) AS n, '### ' || sev || ' (' || count(*) || ')' || chr(10) || string_agg(line, chr(10) ORDER BY finding_id) AS block FROM items GROUP BY review_id, agent, rank, sev),
sections AS (SELECT review_id, agent, sum(n)::BIGINT AS findings, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS section FROM blocks GROUP BY ALL)"""
_VERDICTS = "verdicts AS (SELECT r.review_id, CASE WHEN EXISTS (SELECT 1 FROM findings f WHERE f.review_id = r.review_id AND upper(trim(f.severity)) = 'CRITICAL') THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS verdict FROM reviews r)"
_LINES = tree_plans._TEXTS + """, src AS (SELECT repo_name, file_path, string_split(coalesce(text, ''), chr(10)) AS source FROM texts),
num AS (SELECT repo_name, file_path, len(source)::INT AS lines, list_transform(source, lambda x, i: 'L' || repeat(' ', greatest(0, 4 - length(i::VARCHAR))) || i || ': ' || x) AS marked FROM src)"""
_DIFF_HUNKS = diff_plans.SQL["diff_hunks"]
_REGIONS = f"""hunks AS (SELECT DISTINCT repo_name, file_path, first, last FROM ({_DIFF_HUNKS}) JOIN (SELECT msg_id, repo_name FROM pull_requests) USING (msg_id)),
wide AS (SELECT h.repo_name, h.file_path, greatest(1, first - 3) AS first, least(last + 3, lines) AS last, lines FROM hunks h JOIN num USING (repo_name, file_path) WHERE lines > {SMALL} AND first <= lines),
w2 AS (SELECT *, max(last) OVER (PARTITION BY repo_name, file_path ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wide),
w3 AS (SELECT *, sum(CASE WHEN reach IS NULL OR first > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY repo_name, file_path ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS run FROM w2),
w4 AS (SELECT repo_name, file_path, min(first) AS first, max(last) AS last FROM w3 GROUP BY repo_name, file_path, run),
w5 AS (SELECT *, lag(last) OVER (PARTITION BY repo_name, file_path ORDER BY first) AS prev FROM w4),
shown AS (SELECT repo_name, file_path, string_agg(CASE WHEN prev IS NULL THEN '' ELSE '  ... (lines ' || (prev + 1) || '-' || (first - 1) || ' omitted) ...' || chr(10) END || array_to_string(marked[first:last], chr(10)), chr(10) ORDER BY first) AS body FROM w5 JOIN num USING (repo_name, file_path) GROUP BY ALL)"""
_CALLERS = search_plans._CALLS + ", " + search_plans._DEPS
_LETTERS = "letters AS (SELECT static_id, static_id % 9 <> 0 AS readable, repo_name FROM static_findings)"
_RUN = tree_plans._TEXTS + """, new AS (SELECT repo_name, min(source) AS source FROM sources GROUP BY 1), sizes AS (SELECT repo_name, count(*) AS total_files FROM leaves GROUP BY 1), taken AS (SELECT l.* FROM leaves l JOIN sizes USING (repo_name) WHERE total_files <= 40),
stale AS (SELECT DISTINCT repo_name, file_path FROM chunks WHERE indexed_at IS NULL),
known AS (SELECT l.repo_name, l.file_path, CASE WHEN s.file_path IS NOT NULL THEN 'stale' ELSE hash END AS hash FROM leaves l LEFT JOIN stale s USING (repo_name, file_path) WHERE l.repo_name NOT IN (SELECT repo_name FROM new)),
base AS (SELECT repo_name, file_path, hash, NULL AS source FROM known WHERE repo_name IN (SELECT repo_name FROM taken) UNION ALL SELECT n.repo_name, k.file_path, k.hash, n.source FROM new n JOIN known k ON k.repo_name = n.source WHERE n.repo_name IN (SELECT repo_name FROM taken)),
changes AS (SELECT coalesce(b.repo_name, t.repo_name) AS repo_name, coalesce(b.file_path, t.file_path) AS file_path, t.hash IS NULL AS gone FROM base b FULL JOIN taken t ON b.repo_name = t.repo_name AND b.file_path = t.file_path WHERE b.hash IS DISTINCT FROM t.hash),
made AS (SELECT p.repo_name, sha256(coalesce(content, '')) AS content_hash FROM parts p JOIN changes c ON c.repo_name = p.repo_name AND c.file_path = p.file_path AND NOT gone),
same AS (SELECT t.repo_name, b.source, t.file_path FROM taken t JOIN base b ON b.repo_name = t.repo_name AND b.file_path = t.file_path AND b.hash = t.hash AND b.source IS NOT NULL),
""" + search_plans._CACHE

QUERIES = {
    q.__name__: q
    for q in (review_verdicts, finding_sections, review_summaries, numbered_sources, numbered_regions, change_context, structure_texts, deliveries_routed, failures_classified, dead_letters_by_repo, dead_letters_replayed, index_run, index_applied, embed_missing_keys, cache_unexpired, cascade_deleted, contents_decoded, chunk_payloads, called_names, chunks_matching, index_states, answers_or_raw, prompt_templates, agent_runs)
}
SQL = {
    "review_verdicts": f"WITH {_VERDICTS} SELECT * FROM verdicts",
    "finding_sections": f"WITH {_SECTIONS} SELECT review_id, agent, findings, sha256(section) AS section FROM sections",
    "review_summaries": f"""WITH {_SECTIONS}, {_VERDICTS}, p AS (SELECT review_id, sum(findings) AS n, string_agg('<details>' || chr(10) || '<summary>' || upper(agent[1]) || lower(agent[2:]) || ' (' || findings || ')</summary>' || chr(10) || chr(10) || section || chr(10) || chr(10) || '</details>', chr(10) || chr(10)
  ORDER BY CASE agent WHEN 'security' THEN 1 WHEN 'quality' THEN 2 WHEN 'performance' THEN 3 WHEN 'observability' THEN 4 ELSE 99 END, agent) AS parts FROM sections GROUP BY 1)
SELECT review_id, verdict, sha256('## Code review' || chr(10) || chr(10) || coalesce('Found ' || n || CASE WHEN n = 1 THEN ' issue.' ELSE ' issues.' END || chr(10) || chr(10) || parts, 'No issues found.')) AS summary FROM verdicts LEFT JOIN p USING (review_id)""",
    "numbered_sources": f"WITH {_LINES} SELECT repo_name, file_path, lines, sha256('### ' || file_path || ' (' || lines || ' lines, whole file)' || chr(10) || '```' || chr(10) || array_to_string(marked, chr(10)) || chr(10) || '```') AS shown FROM num",
    "numbered_regions": f"""WITH {_LINES}, {_REGIONS} SELECT repo_name, file_path, lines, sha256('### ' || file_path || ' (' || lines || ' lines' || CASE WHEN lines <= {SMALL} THEN ', whole file)' || chr(10) || '```' || chr(10) || array_to_string(marked, chr(10)) || chr(10) || '```'
  WHEN body IS NULL THEN ', too large, nothing changed)' ELSE ', changed regions and 3 lines around)' || chr(10) || '```' || chr(10) || body || chr(10) || '```' END) AS shown FROM num LEFT JOIN shown USING (repo_name, file_path)""",
    "change_context": f"""WITH {_CALLERS}, ch AS (SELECT DISTINCT repo_name, unnest(changed_files) AS file_path FROM pull_requests),
i1 AS (SELECT repo_name, file_path, dependent FROM deps WHERE (repo_name, file_path) IN (SELECT (repo_name, file_path) FROM ch) AND (repo_name, dependent) NOT IN (SELECT (repo_name, file_path) FROM ch)),
i2 AS (SELECT *, row_number() OVER (PARTITION BY repo_name, file_path ORDER BY dependent) AS place FROM i1),
i3 AS (SELECT repo_name, file_path, '' AS symbol, '**Imported by:**' || chr(10) || string_agg('  - `' || dependent || '`', chr(10) ORDER BY place) AS text FROM i2 WHERE place <= 5 GROUP BY ALL),
c1 AS (SELECT DISTINCT repo_name, defined_in AS file_path, symbol, called_in AS dependent FROM callers WHERE (repo_name, defined_in) IN (SELECT (repo_name, file_path) FROM ch) AND (repo_name, called_in) NOT IN (SELECT (repo_name, file_path) FROM ch)),
c2 AS (SELECT *, row_number() OVER (PARTITION BY repo_name, file_path, symbol ORDER BY dependent) AS place FROM c1),
c3 AS (SELECT repo_name, file_path, symbol, '**`' || symbol || '()` is called by:**' || chr(10) || string_agg('  - `' || dependent || '`', chr(10) ORDER BY place) AS text FROM c2 WHERE place <= 5 GROUP BY repo_name, file_path, symbol)
SELECT repo_name, file_path, '### ' || file_path || ' (changed)' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY symbol) AS context FROM (SELECT * FROM i3 UNION ALL SELECT * FROM c3) GROUP BY repo_name, file_path""",
    "structure_texts": f"SELECT repo_name, file_path, sha256('- ' || file_path || chr(10) || '  Functions: ' || array_to_string(functions, ', ') || chr(10) || '  Classes: ' || array_to_string(classes, ', ')) AS text FROM ({search_plans.SQL['code_graphs']})",
    "deliveries_routed": "WITH RECURSIVE " + event_plans._IDS + """, d AS (SELECT p.msg_id, i.key, p.received_at, CASE WHEN p.msg_id % 11 = 0 THEN 'rejected'
  WHEN (p.msg_id % 4 = 0 AND contains(lower(coalesce(p.body, '')), 'the') AND p.number % 5 <> 0) OR p.msg_id % 4 IN (1, 2) THEN NULL ELSE 'ignored' END AS route FROM pull_requests p JOIN ids i USING (msg_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY received_at, msg_id) AS nth FROM d WHERE route IS NULL AND key IS NOT NULL),
f AS (SELECT key, msg_id, nth, received_at AS opened, TRUE AS kept FROM o WHERE nth = 1 UNION ALL SELECT o.key, o.msg_id, o.nth, CASE WHEN epoch_us(o.received_at) - epoch_us(f.opened) >= 86400000000 THEN o.received_at ELSE f.opened END, epoch_us(o.received_at) - epoch_us(f.opened) >= 86400000000 FROM f JOIN o ON o.key = f.key AND o.nth = f.nth + 1)
SELECT d.msg_id AS delivery_id, coalesce(route, CASE WHEN d.key IS NULL OR kept THEN 'accepted' ELSE 'duplicate' END) AS status FROM d LEFT JOIN f ON f.msg_id = d.msg_id""",
    "failures_classified": """SELECT error, permanent, count(*) AS failures FROM (SELECT error, error IN ('ValidationError','JSONDecodeError','ValueError','TypeError','KeyError','AttributeError') OR coalesce(code IN (401, 403, 404, 422), FALSE) AS permanent
  FROM (SELECT CASE WHEN event_id % 3 = 0 THEN ['ValidationError','JSONDecodeError','ValueError','TypeError','KeyError','AttributeError','TimeoutError','ConnectionError'][event_id % 8 + 1] ELSE 'HTTPError' END AS error, CASE WHEN event_id % 3 <> 0 THEN 400 + event_id % 30 END AS code FROM events WHERE event_type = 'error')) GROUP BY ALL""",
    "dead_letters_by_repo": f"WITH {_LETTERS} SELECT CASE WHEN readable THEN coalesce(repo_name, 'unknown') ELSE 'unreadable' END AS repo, count(*) AS letters FROM letters GROUP BY 1",
    "dead_letters_replayed": f"""WITH {_LETTERS}, one AS (SELECT static_id, readable FROM letters ORDER BY static_id DESC LIMIT 1 OFFSET 10), s1 AS (SELECT static_id FROM one WHERE readable)
SELECT 'all' AS replay, 'sent' AS state, count(*) AS letters, sum(static_id)::BIGINT AS ids FROM letters WHERE readable UNION ALL SELECT 'all', 'left', count(*), sum(static_id)::BIGINT FROM letters WHERE NOT readable
UNION ALL SELECT 'one', 'sent', count(*), sum(static_id)::BIGINT FROM s1 UNION ALL SELECT 'one', 'left', count(*), sum(static_id)::BIGINT FROM letters WHERE static_id NOT IN (SELECT static_id FROM s1)""",
    "index_run": f"""WITH {_RUN}, a AS (SELECT repo_name, count(*) AS files_changed FROM changes GROUP BY 1), b AS (SELECT m.repo_name, count(*) AS total_chunks, count(*) - count(c.content_hash) AS chunks_embedded, count(c.content_hash) AS chunks_cached FROM made m LEFT JOIN cache c USING (content_hash) GROUP BY 1),
d AS (SELECT repo_name, count(*) AS files_copied, min(source) AS simhash_source FROM same GROUP BY 1)
SELECT repo_name, total_files, coalesce(files_changed, 0) AS files_changed, coalesce(total_chunks, 0) AS total_chunks, coalesce(chunks_embedded, 0) AS chunks_embedded, coalesce(chunks_cached, 0) AS chunks_cached, coalesce(files_copied, 0) AS files_copied, simhash_source,
  CASE WHEN total_files > 40 THEN 'more files than 40' END AS skipped_reason FROM sizes LEFT JOIN a USING (repo_name) LEFT JOIN b USING (repo_name) LEFT JOIN d USING (repo_name)""",
    "index_applied": f"""WITH {_RUN}, old AS (SELECT p.repo_name, p.file_path FROM parts p WHERE p.repo_name NOT IN (SELECT repo_name FROM new)),
removed AS (SELECT c.repo_name, c.file_path FROM changes c JOIN (SELECT DISTINCT repo_name, file_path FROM base WHERE source IS NULL) b ON b.repo_name = c.repo_name AND b.file_path = c.file_path),
every AS (SELECT repo_name, FALSE AS copied FROM old WHERE (repo_name, file_path) NOT IN (SELECT (repo_name, file_path) FROM removed) UNION ALL SELECT s.repo_name, TRUE FROM same s JOIN old o ON o.repo_name = s.source AND o.file_path = s.file_path UNION ALL SELECT repo_name, FALSE FROM made)
SELECT repo_name, count(*) AS chunks, count(*) FILTER (copied) AS copied FROM every GROUP BY 1""",
    "embed_missing_keys": f"WITH {search_plans._CACHE} SELECT DISTINCT content_hash, TRUE AS embedded FROM h WHERE content_hash NOT IN (SELECT content_hash FROM cache)",
    "cache_unexpired": "WITH h AS (SELECT repo_name, sha256(content) AS content_hash, indexed_at FROM chunks WHERE content IS NOT NULL), c AS (SELECT content_hash, max(indexed_at) + INTERVAL 7 DAYS AS expires_at FROM h GROUP BY 1), n AS (SELECT max(indexed_at) AS now FROM h) SELECT repo_name, count(*) FILTER (expires_at IS NULL OR expires_at > now) AS hits, count(*) FILTER (expires_at <= now) AS misses FROM h JOIN c USING (content_hash) CROSS JOIN n GROUP BY 1",
    "cascade_deleted": "SELECT finding_id FROM findings WHERE review_id IN (SELECT review_id FROM reviews WHERE status <> 'completed')",
    "contents_decoded": "SELECT chunk_id, sha256(content) AS text_hash FROM chunks WHERE content IS NOT NULL",
    "chunk_payloads": "SELECT content_hash, file_path, repo_name, coalesce(symbol_name, '') AS symbol_name, start_line, coalesce(len(symbols_called), 0)::INT AS calls, length(substring(content, 1, 300))::INT AS size FROM chunks WHERE content_hash IS NOT NULL",
    "called_names": "SELECT name, count(*) AS calls FROM (SELECT regexp_extract(c, '[^.]*$') AS name FROM (SELECT unnest(symbols_called) AS c FROM chunks)) WHERE regexp_full_match(name, '[A-Za-z_]\\w*') GROUP BY 1",
    "chunks_matching": "WITH n AS (SELECT name FROM (SELECT regexp_extract(c, '[^.]*$') AS name FROM (SELECT unnest(symbols_called) AS c FROM chunks)) WHERE regexp_full_match(name, '[A-Za-z_]\\w*') GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 5) SELECT chunk_id FROM chunks WHERE lower(trim(chunk_type)) = 'function' AND list_has_any(symbols_called, (SELECT list(name) FROM n))",
    "index_states": f"SELECT c.repo_name, coalesce(state, 'none') AS state FROM (SELECT DISTINCT repo_name FROM chunks) c LEFT JOIN ({event_plans.SQL['latest_runs']}) r ON r.repo_name = c.repo_name",
    "answers_or_raw": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN try_cast(props ->> '$.k' AS BIGINT) END AS k, CASE WHEN event_id % 5 = 0 THEN 'I think: ' || props END AS raw_text FROM events",
    "prompt_templates": f"SELECT agent, step, temperature, TRUE AS written FROM (SELECT unnest({list(chain.AGENTS)!r}) AS agent) CROSS JOIN (VALUES {', '.join(f'({name!r}, {heat}::DOUBLE)' for name, heat, _ in chain.STEPS)}) s(step, temperature)",
    "agent_runs": f"""WITH p AS (SELECT msg_id AS id, length(patch) % 2 = 1 AS fine FROM ({diff_plans.SQL['diff_by_file']})), n AS (SELECT id, count(*) AS parts, count(*) FILTER (fine) AS good FROM p GROUP BY 1), w AS (SELECT msg_id AS id, coalesce(parts, 0) AS parts, coalesce(good, 0) AS good FROM pull_requests LEFT JOIN n ON n.id = msg_id WHERE diff IS NOT NULL)
SELECT id, CASE WHEN parts > 1 AND good > 0 THEN 'files' ELSE 'whole' END AS mode, CASE WHEN parts > 1 AND good > 0 THEN parts ELSE 1 END AS answers, CASE WHEN parts > 1 AND good > 0 THEN parts - good ELSE 0 END AS failed FROM w""",
}
