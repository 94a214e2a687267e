import base64
import json

import pytest
from pyspark.sql import functions as F

from codesift.operators import chain, events, indexing, rendering, rules, search, trees
from codesift.sources import paged, sinks, snapshots


def test_rules_by_line_and_by_call(spark):
    fired = {
        "python-sqli-fstring": ("a.py", 'q = f"SELECT a FROM t WHERE x = {y}"'), "python-sqli-concat": ("a.py", 'q = "DELETE FROM t WHERE x = " + y'), "python-hardcoded-secret": ("a.py", 'database_url = "x://y"'), "python-unsafe-pickle": ("a.py", "pickle.loads(x)"),
        "python-unsafe-yaml": ("a.py", "x = yaml.load(\n    f(a),\n    y,\n)"), "python-eval-exec": ("a.py", "exec(x)"), "python-cmd-injection": ("a.py", "os.popen(x)"), "python-subprocess-shell": ("a.py", "\nsubprocess.run(\n  [a(b)],\n  shell = True,\n)"), "js-xss-innerhtml": ("a.ts", "a.innerHTML = b"), "js-xss-dangerous-html": ("a.tsx", "<a dangerouslySetInnerHTML={b}/>"),
        "js-xss-document-write": ("a.js", "document.write(x)"), "js-eval": ("a.jsx", "eval(x)"), "js-hardcoded-secret": ("a.js", "const apiKeyToken = 'abcdef'"), "go-sqli-sprintf": ("a.go", 'fmt.Sprintf(\n\t"select * from t where a = %s", b)'), "go-cmd-injection": ("a.go", 'exec.Command("sh", x)'),
    }
    quiet = [
        ("a.py", "yaml.load(\n  x,\n  Loader=yaml.SafeLoader)"), ("a.py", 'password = "changeme"'), ("a.py", "# yaml.load(x)"), ("a.py", "subprocess.run(f(shell=x), y)\nz(shell=True)"), ("a.js", "const token = 'xxx'"), ("a.md", "eval(x)"), ("a.py", None), (None, "eval(x)"), ("a.rs", "eval(x)"),
        ("a.py", "subprocess.check(x, shell=True)"), ("a.py", 'x = ("select one")'),
    ]
    cases = [*fired.values(), *quiet]
    chunks = spark.createDataFrame([(i, "r", p, t) for i, (p, t) in enumerate(cases)], "chunk_id INT, repo_name STRING, file_path STRING, content STRING")
    found = rules.scan(rules.code_lines(chunks)).select("chunk_id", "rule_id", "line_no").unionByName(rules.scan_calls(chunks).select("chunk_id", "rule_id", "line_no"))
    assert sorted((r.chunk_id, r.rule_id) for r in found.collect()) == sorted(enumerate(fired))
    lines = {r.rule_id: r.line_no for r in found.collect()}
    assert lines["python-subprocess-shell"] == 2 and lines["python-unsafe-yaml"] == 1
    assert len(rules.RULES) == len(fired) == 15 and rules.scan_calls(chunks.limit(0)).count() == 0


def test_numbered_source(spark):
    files = spark.createDataFrame([("r", "a", "x\ny"), ("r", "b", "\n".join(f"l{i}" for i in range(1, 31))), ("r", "c", "\n" * 30), ("r", "d", None)], "repo_name STRING, file_path STRING, text STRING")
    hunks = spark.createDataFrame([("r", "b", 4, 5), ("r", "b", 20, 20), ("r", "b", 8, 8), ("r", "b", 99, 99), ("r", "a", 1, 1)], "repo_name STRING, file_path STRING, first INT, last INT")
    shown = {r.file_path: r.shown for r in rendering.numbered_source(files, hunks, 10, 2).collect()}
    assert shown["a"] == "### a (2 lines, whole file)\n```\nL   1: x\nL   2: y\n```"
    assert shown["b"].split("\n")[2:12] == [*(f"L{i:>4}: l{i}" for i in range(2, 11)), "  ... (lines 11-17 omitted) ..."] and shown["b"].endswith("L  22: l22\n```")
    assert shown["c"] == "### c (31 lines, too large, nothing changed)" and shown["d"].startswith("### d (1 lines, whole file)")


def test_summaries_and_verdicts(spark):
    schema = "review_id STRING, agent STRING, finding_id INT, severity STRING, file_path STRING, line_number INT, description STRING, current_code STRING, suggested_fix STRING"
    findings = spark.createDataFrame([("v", "quality", 1, "low", "f", 3, "late", " a ", "b"), ("v", "security", 2, "critical", "f", None, "first", None, "b"), ("v", "security", 3, "odd", None, 1, None, "", ""), (None, "quality", 4, "CRITICAL", "f", 1, "x", "", "")], schema)
    reviews = spark.createDataFrame([("v",), ("w",)], "review_id STRING")
    out = {r.review_id: r for r in rendering.summaries(findings, reviews).collect()}
    assert out["v"].verdict == "REQUEST_CHANGES" and out["w"].verdict == "COMMENT" and out["w"].summary.endswith("No issues found.")
    text = out["v"].summary
    assert "Found 3 issues." in text and text.index("Security (2)") < text.index("### CRITICAL (1)") < text.index("### INFO (1)") < text.index("Quality (1)")
    assert "- `f:3` — late\n```diff\n- a\n+ b\n```" in text and "- `f:?` — first\n" in text and "- `?:1` — " in text


def test_context_of_changed_files(spark):
    arrays = "ARRAY<STRING>"
    chunks = spark.createDataFrame([(1, "r", "pkg/a.py", ["go"], [], []), (2, "r", "b.py", [], ["go"], ["pkg.a"]), (3, "r", "c.py", [], ["go"], []), (4, "s", "d.py", [], ["go"], ["pkg.a"]), (5, "r", "e.py", None, None, None)], f"chunk_id INT, repo_name STRING, file_path STRING, symbols_defined {arrays}, symbols_called {arrays}, imports {arrays}")
    changed = spark.createDataFrame([("r", "pkg/a.py"), ("r", "c.py"), ("r", "pkg/a.py")], "repo_name STRING, file_path STRING")
    got = rendering.cross_file_context(changed, chunks).collect()
    assert [(r.file_path, r.context) for r in got] == [("pkg/a.py", "### pkg/a.py (changed)\n**Imported by:**\n  - `b.py`\n\n**`go()` is called by:**\n  - `b.py`")]
    assert [r.dependent for r in search.dependents(chunks).collect()] == ["b.py"]


def test_index_run_builds_copies_and_refreshes(spark, rows):
    schema = "repo_name STRING, file_path STRING, text STRING"
    files = spark.createDataFrame([("new", "a.py", "x = 1"), ("new", "b.py", "y = 2"), ("old", "c.py", "z = 3"), ("old", "d.py", "w = 4"), ("lone", "e.py", "x = 1"), ("big", "f.py", "1"), ("big", "g.py", "2"), ("big", "h.py", "3")], schema)
    before = spark.createDataFrame([("src", "a.py", "x = 1"), ("src", "b.py", "y = 9"), ("src", "gone.py", "g"), ("old", "c.py", "z = 3"), ("old", "d.py", "w = 0"), ("old", "lost.py", "l")], schema)
    known = trees.leaf_hashes(before)
    sources = spark.createDataFrame([("new", "src"), ("old", "src")], "repo_name STRING, source STRING")
    cache = spark.createDataFrame([("x = 1",)], "t STRING").select(F.sha2(F.col("t").cast("binary"), 256).alias("content_hash"))
    run = indexing.run_index(files, known, sources, cache, most_files=2)
    stats = {r.repo_name: r for r in run.stats.collect()}
    counted = {k: (r.total_files, r.files_changed, r.total_chunks, r.chunks_embedded, r.chunks_cached, r.files_copied) for k, r in stats.items()}
    assert counted == {"new": (2, 2, 1, 1, 0, 1), "old": (2, 2, 1, 1, 0, 0), "lone": (1, 1, 1, 0, 1, 0), "big": (3, 0, 0, 0, 0, 0)}
    assert stats["new"].simhash_source == "src" and stats["old"].simhash_source is None and stats["big"].skipped_reason == "more files than 2"
    assert rows(run.removed) == [("old", "d.py"), ("old", "lost.py")] and run.vectors.count() == 2
    index = before.select("repo_name", "file_path", F.lit(0).alias("chunk_index"), F.lit("h").alias("content_hash"), F.col("text").alias("content"))
    after = rows(indexing.applied(index, run).where("repo_name IN ('new', 'old')"), "repo_name", "file_path", "content", "copied_from")
    assert after == [("new", "a.py", "x = 1", "src"), ("new", "b.py", "y = 2", None), ("old", "c.py", "z = 3", None), ("old", "d.py", "w = 4", None)]
    assert indexing.run_index(files.limit(0), known, sources, cache).stats.count() == 0


def test_cache_entries_run_out(spark):
    cache = spark.createDataFrame([("a", 5), ("b", 15), ("c", None), ("a", 7)], "content_hash STRING, s INT").select("content_hash", F.timestamp_seconds("s").alias("expires_at"))
    chunks = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x"), (None, "x")], "content_hash STRING, text STRING")
    hits = {r.content_hash for r in search.cache_lookup(chunks, cache, F.timestamp_seconds(F.lit(10))).where("hit").collect()}
    assert hits == {"b", "c"} and search.cache_lookup(chunks, cache).where("hit").count() == 3


def test_routing(spark):
    given = [
        (1, "k", 0, True, "pull_request", "opened", None, None), (2, "k", 10, True, "pull_request", "synchronize", None, None), (3, "k", 90_000, True, "pull_request", "opened", None, None), (4, "k", 5, False, "pull_request", "opened", None, None), (5, "k", 1, True, "pull_request", "closed", None, None), (6, "m", 2, True, "issue_comment", "created", " please /REVIEW ", True),
        (7, "n", 2, True, "issue_comment", "created", "/review", False), (8, "n", 3, True, "issue_comment", "created", "nice", True), (9, None, 3, True, "pull_request", "opened", None, None), (10, None, 3, True, "pull_request", "opened", None, None), (11, "o", 3, None, None, None, None, None), (12, "p", 3, True, None, None, None, None),
    ]
    rows_ = spark.createDataFrame(given, "delivery_id INT, key STRING, s INT, valid BOOLEAN, event STRING, action STRING, comment STRING, on_pull BOOLEAN").withColumn("at", F.timestamp_seconds("s"))
    got = {r.delivery_id: r.status for r in events.routed(rows_).collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "accepted", 4: "rejected", 5: "ignored", 6: "accepted", 7: "ignored", 8: "ignored", 9: "accepted", 10: "accepted", 11: "rejected", 12: "ignored"}


def test_dead_letters(spark, rows):
    letters = spark.createDataFrame([(1, '{"repo": "a"}'), (2, "lost"), (3, '{"repo": "b"}'), (4, None)], "id INT, letter STRING")
    read = events.parsed_letters(letters, "repo STRING")
    order = [F.col("id")]
    sent, left = events.replayed(read, order, "id", "body")
    assert rows(sent, "id") == [(1,), (3,)] and rows(left, "id") == [(2,), (4,)]
    sent, left = events.replayed(read, order, "id", "body", 1)
    assert rows(sent, "id") == [] and left.count() == 4
    assert rows(events.without_index(letters, order, 2, "id"), "id") == [(1,), (2,), (4,)] and events.without_index(letters, order, 9, "id").count() == 4
    checked = spark.createDataFrame([("ValueError", None), ("HTTPError", 422), ("HTTPError", 503), (None, None)], "e STRING, c INT").select(events.is_permanent(F.col("e"), F.col("c")))
    assert [r[0] for r in checked.collect()] == [True, True, False, False]


def test_open_spans_over_buckets(spark):
    spans = [("a", 0, 10), ("a", 5, 8000), ("a", 7900, 9000), ("a", 10, None), (None, 1, 2), ("b", None, 3)]
    df = spark.createDataFrame(spans, "k STRING, x INT, y INT").select("k", F.timestamp_seconds("x").alias("x"), F.timestamp_seconds("y").alias("y"))
    for width in (1, 3600, 10**6):
        got = {r.k: (r.most, r.at.timestamp() if r.at else None) for r in events.in_flight(df, ["k"], "x", "y", width).collect()}
        assert got["a"] == (3, 7900.0) and got[None] == (1, 1.0)


def test_runs_by_file_and_answers(spark, rows):
    def model(text):
        if "bad" in text:
            raise ValueError(text)
        return text.upper()

    parts = spark.createDataFrame([(1, "a", "x"), (1, "b", "bad"), (2, "a", "bad"), (2, "b", "bad"), (3, "a", "x")], "id BIGINT, file_path STRING, patch STRING")
    whole = spark.createDataFrame([(1, "w"), (2, "w"), (3, "w"), (4, "bad")], "id BIGINT, text STRING")
    got = rows(chain.run_per_file(parts, whole, model), "id", "mode", "answer", "failed")
    assert got == [(1, "files", "X", False), (1, "files", None, True), (2, "whole", "W", False), (3, "whole", "W", False), (4, "whole", None, True)]
    answers = spark.createDataFrame([('```json\n{"k": 1}\n```',), ("no",), ("{bad",), (None,)], "t STRING").select(chain.parsed_or_raw(F.col("t"), "k INT").alias("a")).select("a.value.k", "a.raw_text")
    assert [tuple(r) for r in answers.collect()] == [(1, None), (None, "no"), (None, "{bad"), (None, None)]
    assert chain.templates(spark).count() == 16


def test_snapshots(spark, rows):
    leaves = spark.createDataFrame([("r", "b", "2"), ("r", "a", "1"), ("s", "a", None)], "repo_name STRING, file_path STRING, hash STRING")
    assert rows(snapshots.tree_rows(snapshots.tree_text(leaves))) == rows(leaves)
    wire = base64.b64encode(("é\n" * 50).encode()).decode()
    texts = spark.createDataFrame([(wire[:40] + "\n" + wire[40:],), ("%%",), (None,)], "w STRING").select(snapshots.decoded(F.col("w")))
    assert [r[0] for r in texts.collect()] == ["é\n" * 50, None, None]
    got = snapshots.lookup(leaves, spark.createDataFrame([("a",), ("z",)], "file_path STRING"), ["hash"])
    assert rows(got) == [("a", "1"), ("a", None), ("z", None)]
    children = spark.createDataFrame([(1, "v"), (2, "w"), (3, None)], "id INT, review_id STRING")
    assert rows(snapshots.cascaded(children.where("id <> 2"), children, "review_id"), "id") == [(1,)]
    assert rows(snapshots.matching(leaves.withColumn("t", F.array("file_path")), {"repo_name": "r"}, {"t": ["a", "q"]}), "file_path") == [("a",)]


def test_sinks(spark, rows, tmp_path):
    one = spark.createDataFrame([(1, "a")], "id INT, x STRING")
    write = sinks.batches_into(str(tmp_path / "dead"))
    for number in (0, 1, 1):
        write(one, number)
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 2
    folder = str(tmp_path / "audit")
    assert sinks.publish_together({"reviews": one, "findings": one}, folder, "7") and not sinks.publish_together({"reviews": one}, folder, "7")

    broken = one.select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        sinks.publish_together({"reviews": one, "findings": broken}, folder, "8")
    assert not (tmp_path / "audit" / "run=8").exists()
    assert sinks.publish_together({"reviews": one, "findings": one}, folder, "8")

    def inline(review, summary, comments):
        if comments:
            raise ValueError("line is not part of the diff")

    def plain(review, summary, comments):
        if review == "c":
            raise ValueError("gone")

    reviews = spark.createDataFrame([("a", "s", []), ("b", "s", ["x"]), ("c", "s", ["x"]), ("d", "s", None)], "review_id STRING, summary STRING, comments ARRAY<STRING>")
    got = rows(sinks.post(reviews, [("inline", inline), ("plain", plain)]), "review_id", "posted_by")
    assert got == [("a", "inline"), ("b", "plain"), ("c", None), ("d", "inline")]


def test_tables(spark):
    try:
        assert len(sinks.create_tables(spark, "audit_test")) == 7 and len(sinks.create_tables(spark, "audit_test")) == 7
        assert "repo_name" in [r.name for r in spark.catalog.listColumns("audit_test.repo_chunks") if r.isPartition]
    finally:
        spark.sql("DROP DATABASE IF EXISTS audit_test CASCADE")


def test_paged_source(spark, rows, tmp_path):
    for n in (1, 2):
        (tmp_path / f"p{n}.json").write_text(json.dumps([{"number": n, "title": f"t{n}", "other": 1}, {"number": n * 10}]))
    spark.dataSource.register(paged.Pages)
    read = spark.read.format("pages").schema("number INT, title STRING").option("url", f"file://{tmp_path}/p{{page}}.json").option("pages", 2).load()
    assert rows(read) == sorted([(1, "t1"), (10, None), (2, "t2"), (20, None)], key=repr)


def test_periodic_jobs_go_on_where_they_stopped(spark, rows, tmp_path):
    from codesift.streaming import events as streams

    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    write = sinks.batches_into(str(tmp_path / "out"))
    read = lambda: spark.readStream.schema("id BIGINT").parquet(source)
    streams.run_every(read(), str(tmp_path / "log"), write).awaitTermination()
    spark.range(3, 5).write.mode("append").parquet(source)
    job = streams.run_every(read(), str(tmp_path / "log"), write, "1 second")
    job.processAllAvailable()
    job.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id") == [(i,) for i in range(5)]


def test_calls_from_outside(spark, rows):
    arrays = "ARRAY<STRING>"
    chunks = spark.createDataFrame([(1, "r", "a", ["f"], ["f"]), (2, "r", "b", ["f"], ["f"]), (3, "r", "c", ["g"], ["g", "f"]), (4, "r", "d", None, ["h"]), (5, "s", "a", [], ["f"])], f"chunk_id INT, repo_name STRING, file_path STRING, symbols_defined {arrays}, symbols_called {arrays}")
    assert rows(search.calls_from_outside(chunks), "symbol", "chunk_id") == [("f", 1), ("f", 2), ("f", 3)]


def test_a_scan_of_one_piece_is_spread(spark, rows, tmp_path):
    from codesift.runtime import spread

    cores = spark.sparkContext.defaultParallelism
    for pieces in (1, 2 * cores):
        path = str(tmp_path / f"t{pieces}")
        spark.range(100).repartition(pieces, "id").write.parquet(path)
        read = spark.read.parquet(path)
        assert sorted(r.id for r in spread(read, "id").collect()) == list(range(100))
    one = spark.read.parquet(str(tmp_path / "t1"))
    assert one.rdd.getNumPartitions() == 1 and spread(one, "id").rdd.getNumPartitions() == cores
