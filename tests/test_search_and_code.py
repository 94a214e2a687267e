import hashlib
import hmac

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesift.operators import chain, chunking, dag, rules, search
from codesift.plans import code
from codesift.sources import snapshots


def test_nearest_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 8)).astype(np.float32)
    data[7] = data[11]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(900, None), (901, []), (902, [0.0] * 8)], "vec_id BIGINT, embedding ARRAY<FLOAT>").repartition(4)
    got = {(r.query_id, r.place): r.vec_id for r in search.nearest_vectors(df, df.where("vec_id % 50 = 0"), 5, max_queries=3, block=2).collect()}
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    for q in range(0, 300, 50):
        score = np.round(unit @ unit[q], 6)
        order = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:5]
        assert [got[q, k + 1] for k in range(5)] == order
    assert search.nearest_vectors(df, df.limit(0), 5).count() == 0


def test_callers_dependents_and_blast(spark, rows):
    df = spark.createDataFrame(
        [(1, "r", "pkg/a.py", ["f"], [], []), (2, "r", "b.py", ["g"], ["f", "g"], ["pkg.a"]), (3, "r", "c.py", None, ["f"], ["a", "x"]), (4, "s", "d.py", [], ["f"], ["pkg.a"])],
        "chunk_id BIGINT, repo_name STRING, file_path STRING, symbols_defined ARRAY<STRING>, symbols_called ARRAY<STRING>, imports ARRAY<STRING>",
    )
    assert rows(search.callers(df), "defined_in", "called_in") == [("pkg/a.py", "b.py"), ("pkg/a.py", "c.py")]
    assert rows(search.dependents(df), "file_path", "dependent") == [("pkg/a.py", "b.py"), ("pkg/a.py", "c.py")]
    changed = spark.createDataFrame([("r", "pkg/a.py")], "repo_name STRING, file_path STRING")
    assert rows(search.blast_radius(changed, df), "reached", "why") == [("b.py", "call"), ("b.py", "import"), ("c.py", "call"), ("c.py", "import")]


def test_transitive_on_a_cycle(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src STRING, dst STRING")
    assert len(rows(search.transitive(edges, 5))) == 9


def test_embedding_once_per_text(spark):
    df = spark.createDataFrame([("h1", "some text"), ("h1", "some text"), ("h2", " "), ("h3", "x")], "content_hash STRING, text STRING")
    cache = spark.createDataFrame([("h3",)], "content_hash STRING")
    got = {r.content_hash: r.embedding for r in search.embed_missing(df, cache, search.hash_embedder(16)).collect()}
    assert set(got) == {"h1", "h2"} and abs(sum(x * x for x in got["h1"]) - 1) < 1e-5 and not any(got["h2"])


SOURCE = '''import os
import sys

from x import y

@decorated
def small(a, *b, c=1):
    if a and b:
        for i in b:
            print(i)
    return os.path.join(a)

class K(Base):
    """Doc."""
    n = 1

    def method(self):
        return small(self.n)

LEFT = 1
'''


def test_chunks_cover_every_line_once():
    for text, extension in ((SOURCE, "py"), ("package a\n\nimport (\n\t\"x\"\n)\n\nfunc F() int {\n\treturn 1\n}\n\ntype T struct {\n\ta int\n}\n", "go"), ("a\n" * 70, "py"), ("export function f(a) {\n  return { a };\n}\nconst x = 1;\n", "js"), ("def broken(:\n", "py"), ("", "rs"), ("x\ny", "md")):
        lines = text.split("\n")
        covered = [i for a, b, _, _ in chunking.file_spans(text, extension) for i in range(a, b + 1)]
        assert len(covered) == len(set(covered))
        assert {i for i, line in enumerate(lines, 1) if line.strip()} <= set(covered)


def test_structure_of_python():
    kinds = [(k, n) for _, _, k, n in chunking.file_spans(SOURCE, "py")]
    assert ("function", "small") in kinds and ("class_header", "K") in kinds and ("function", "method") in kinds and ("top_level", "") in kinds
    large = "def f():\n" + "".join(f"    if a{i}:\n" + "        b()\n" * 14 for i in range(5))
    parts = [n for _, _, k, n in chunking.file_spans(large, "py") if k == "function"]
    assert parts[0] == "f_part1" and len(parts) > 2


def test_metrics():
    by_name = {m[0]: m for m in chunking.function_metrics(SOURCE)}
    assert by_name["small"][3] == 3 and by_name["small"][4] == 4 and by_name["small"][5] == 2 and by_name["small"][6] == ["join", "print"] or set(by_name["small"][6]) == {"join", "print"}


@pytest.mark.parametrize(("path", "line", "rule"), [("a.py", "x = pickle.loads(b)", "python-unsafe-pickle"), ("a.py", "os.system(c)", "python-cmd-injection"), ("a.ts", "el.innerHTML = v", "js-xss-innerhtml"), ("a.go", 'q := fmt.Sprintf("SELECT %s", v)', "go-sqli-sprintf"), ("a.py", "# eval(x)", None), ("a.js", "retrieval(x)", None), ("a.rs", "eval(x)", None)])
def test_rules(spark, path, line, rule):
    df = spark.createDataFrame([(1, "r", path, line)], "chunk_id BIGINT, repo_name STRING, file_path STRING, content STRING")
    assert [r.rule_id for r in rules.scan_chunks(df).collect()] == ([rule] if rule else [])


def test_task_graph(spark, rows):
    tasks = spark.createDataFrame([("a", "x", "completed"), ("b", "x", "failed"), ("c", "x", "pending"), ("d", "x", "pending"), ("e", "aggregator", "pending"), ("y", "x", "pending"), ("z", "x", "pending")], "id STRING, role STRING, status STRING")
    edges = spark.createDataFrame([("a", "c"), ("b", "d"), ("d", "e"), ("y", "z"), ("z", "y"), ("ghost", "c")], "src STRING, dst STRING")
    assert rows(dag.unknown_dependencies(tasks, edges)) == [("ghost", "c")]
    known = edges.where("src <> 'ghost'")
    assert rows(dag.ready(tasks, known)) == [("c",), ("d",)]
    assert rows(dag.on_cycles(tasks, known)) == [("y",), ("z",)]
    assert rows(dag.levels(tasks, known).where("level IS NOT NULL")) == [("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 2)]
    assert rows(dag.skipped_by_failure(tasks, known, 5)) == [("d",)]


def test_answers(spark):
    df = spark.createDataFrame([('```json\n{"k": 1}\n```',), ('{"k": 2}',), ("no json",), (None,)], "t STRING")
    assert [r[0] for r in df.select(chain.parsed(df.t, "k INT")["k"]).collect()] == [1, 2, None, None]
    assert df.select(chain.render("a {x} {y}", {"x": F.lit("1"), "y": F.lit(None).cast("string")})).first()[0] == "a 1 {unavailable: y}"


def test_chain_repairs(spark):
    df = spark.createDataFrame([(1, "t"), (2, None)], "id BIGINT, text STRING")
    out = {r.id: r for r in chain.run_chain(df, [("one", "A {text}"), ("two", "B {one}")], lambda p: p if not p.startswith("Repair") else "fixed", lambda a: a == "fixed").collect()}
    assert out[1].answer == "fixed" and out[1].steps == 3 and out[2].valid


def test_signatures(spark):
    good = "sha256=" + hmac.new(b"s", b"body", hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("body", good), ("body", "sha256=0"), (None, good), ("body", None)], "b STRING, g STRING")
    assert [r[0] for r in df.select(chain.verified("s")(df.b, df.g)).collect()] == [True, False, False, False]
    assert not df.select(chain.verified("")(df.b, df.g)).first()[0]


def test_source_tree(spark, tmp_path, rows):
    for name, text in {"a.py": "x", "src/b.go": "y", ".hidden/c.py": "z", "node_modules/d.js": "w", ".github/e.py": "v", "n.txt": "u", "node_modules.py": "t"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert rows(snapshots.read_tree(spark, str(tmp_path)), "file_path", "text") == [(".github/e.py", "v"), ("a.py", "x"), ("node_modules.py", "t"), ("src/b.go", "y")]


def test_index_tables(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "r", 1), (1, "r", 2), (2, "s", None)], "id INT, repo_name STRING, v INT")
    assert rows(snapshots.newest(df, ["id"], ["v"]), "id", "v") == [(1, 2), (2, None)]
    path = str(tmp_path / "t")
    snapshots.replace_partitions(df, path, "repo_name")
    snapshots.replace_partitions(df.where("id = 2").withColumn("v", F.lit(9)), path, "repo_name")
    assert rows(spark.read.parquet(path), "id", "v") == [(1, 1), (1, 2), (2, 9)]
    assert snapshots.copied(df, "r", "q").where("copied_from = 'r' AND repo_name = 'q'").count() == 2
    assert rows(snapshots.without_keys(df, spark.createDataFrame([("r",)], "repo_name STRING")), "id") == [(2,)]
    paths = spark.createDataFrame([("x/src/a.py",), ("b.py",), ("ya.py",)], "file_path STRING")
    assert rows(snapshots.by_suffix(paths, spark.createDataFrame([("src/a.py",), ("deep/b.py",), ("a.py",)], "file_path STRING"))) == [("b.py",), ("x/src/a.py",)]


@pytest.mark.parametrize(
    ("extension", "text", "wanted"),
    [
        ("js", "async function f(a, {b, c}) {\n  if (a && b) { for (const x of c) { try { x.run(`} ${g(x)}`) } catch (e) { } } }\n}\nclass A {\n  get(k) { return k ? /[{(]/.test(k) : new B(k) }\n}", {"f": (1, 3, 2, 5, 3, ["run", "g"]), "get": (5, 5, 1, 2, 0, ["test"])}),
        ("jsx", "const App = ({ items }) => <p onClick={() => go(1)}>don't {items.map((i) => i.ok && show(i))} it's</p>;\nfunction last() { return 1 }", {"App": (1, 1, 1, 2, 0, ["go", "map", "show"]), "last": (2, 2, 0, 1, 0, [])}),
        ("ts", "interface I { m(a: T): void }\nclass S {\n  abstract s(a: T): void\n  async bar<K>(k: Map<K, T>, f?: (a: K) => void): Promise<Map<K, T>> { while (k) { f<K>(k) } }\n}", {"bar": (4, 4, 2, 2, 1, ["f"])}),
        ("tsx", "export const f = <T,>(a: T): { x: number } => {\n  return <B c={<d>{h(a)}</d>} />;\n}", {"f": (1, 3, 1, 1, 0, ["h"])}),
        ("go", "package a\nfunc (s *T) Do(a, b int) (interface{}, error) {\n\tswitch a {\n\tcase 1:\n\t\tif a > 0 || b > 0 {\n\t\t\tg(`{`)\n\t\t}\n\tdefault:\n\t}\n\treturn nil, nil\n}\nfunc Map[T any](x []T) map[string]int { return nil }", {"Do": (2, 11, 2, 4, 2, ["g"]), "Map": (12, 12, 1, 1, 0, [])}),
        ("rs", "impl<'a> S<'a> {\n    fn f<T: Fn(u8) -> u8>(&mut self, x: Map<A, B>) -> u8 {\n        for i in 0..n { if let Some(y) = a::g(i) { w!('{', h(y)) } }\n        match x { Some(v) if ok(v) => 1, _ => 2 }\n    }\n}\ntrait T { fn sig(&self); }", {"f": (2, 5, 2, 6, 2, ["g", "h", "ok"])}),
        ("go", "package a\nfunc a() { f(] }\nfunc b(x int) { g() }", {"a": (2, 2, 0, 1, 0, ["f"]), "b": (3, 3, 1, 1, 0, ["g"])}),
        ("py", "def a(x):\n    return g(x)\n\ndef b(:\n    pass\n\nclass K:\n    def m(self, y):\n        z = = 1\n        if y:\n            return h(y)\n", {"a": (1, 2, 1, 1, 0, ["g"]), "m": (8, 11, 2, 2, 1, ["h"])}),
    ],
)
def test_metrics_of_each_language(extension, text, wanted):
    got = chunking.function_metrics(text, extension)
    assert {m[0]: m[1:] for m in got} == wanted and len(got) == len(wanted)


def test_measured_files(spark, rows):
    texts = {"py": "def f(): pass", "js": "function f() {}", "jsx": "function f() {}", "ts": "function f() {}", "tsx": "function f() {}", "go": "package a\nfunc f() {}", "rs": "fn f() {}", "md": "function f() {}"}
    df = spark.createDataFrame([("r", f"a.{e}", t) for e, t in texts.items()] + [("r", "b.GO", None)], "repo_name STRING, file_path STRING, text STRING")
    assert rows(chunking.measure_functions(df), "file_path", "name") == sorted((f"a.{e}", "f") for e in texts if e != "md")


def test_heads_of_every_kind(spark):
    heads = {
        "python": {"function": ["def f(x):", "    async def g("], "type": ["class K:", "class L(K):"]},
        "javascript": {"function": ["export async function f(a) {", "export default function g() {", "function* h() {"], "arrow": ["const f = (a) => a", "export const g = async (a: T): Promise<U> => {", "  const h = x => x", "const i: F = <T>(a) => a"], "type": ["export interface I {", "type T = A | B", "class K {", "export abstract class L {", "enum E {"]},
        "go": {"function": ["func F(a int) {", "func (s *T) G() {", "func Map[T any](x []T) {"], "type": ["type T struct {", "type I interface{ F() }", "type L[T any] struct {"]},
        "rust": {"function": ["pub async fn f() {", "    pub(crate) unsafe fn g() {"], "type": ["pub struct S;", "enum E {", "pub(crate) trait T {"], "impl": ["impl S {", "impl<'a, T: Into<U>> fmt::Display for S<T> {"]},
    }
    none = [("javascript", "functional(x)"), ("javascript", "const x = (a)"), ("javascript", "const ok = a >= (b)"), ("go", "type ID int"), ("rust", "let x = implement(1);")]
    df = spark.createDataFrame([("r", language, line) for language, kinds in heads.items() for lines in kinds.values() for line in lines] + [("r", *n) for n in none], "repo_name STRING, language STRING, line STRING")
    got = {(r.language, r.kind): r.heads for r in code.count_heads(df).collect()}
    assert got == {(language, kind): len(lines) for language, kinds in heads.items() for kind, lines in kinds.items()}


def test_symbols_of_chunks(spark):
    texts = {
        "py": "import os, sys\nfrom .x import y\n\ndef f(a):\n    return os.path.join(g(a))\n",
        "js": "import a, { b } from 'x';\nimport 'z';\nconst q = require(\"r\");\n\nfunction f(p) {\n  return p.g(`${h(p)}`);\n}\n",
        "go": "package a\n\nimport (\n\tf \"fmt\"\n\t\"os\"\n)\n\nfunc F(a int) {\n\tg(a)\n}\n",
        "rs": "use a::{b, c};\n\nfn f() {\n    a::g(1);\n}\n",
        "md": "f(x)\n",
    }
    df = spark.createDataFrame([("r", f"a.{e}", t) for e, t in texts.items()], "repo_name STRING, file_path STRING, text STRING")
    got = chunking.chunk_files(df).collect()
    assert {r.file_path[2:]: (r.symbols_defined, r.symbols_called) for r in got if r.chunk_type == "function"} == {"py": (["f"], ["join", "g"]), "js": (["f"], ["g", "h"]), "go": (["F"], ["g"]), "rs": (["f"], ["g"])}
    imports = {}
    for r in sorted(got, key=lambda r: r.chunk_index):
        imports.setdefault(r.file_path[2:], []).extend(r.imports)
    assert imports == {"py": ["os", "sys", ".x"], "js": ["x", "z", "r"], "go": ["fmt", "os"], "rs": ["a::{b, c}"], "md": []}
    large = "def f():\n" + "".join(f"    if a{i}:\n" + "        b()\n" * 14 for i in range(5))
    parts = chunking.chunk_files(spark.createDataFrame([("r", "l.py", large)], "repo_name STRING, file_path STRING, text STRING")).where("chunk_type = 'function'").orderBy("chunk_index").collect()
    assert parts[0].symbols_defined == ["f"] and not any(r.symbols_defined for r in parts[1:]) and all(r.symbols_called == ["b"] for r in parts)


def test_index_finds_what_brute_force_finds(spark):
    from codesift.operators import vector_index

    rng = np.random.default_rng(3)
    hubs = rng.normal(size=(30, 32))
    points = hubs[rng.integers(0, 30, 3000) * (rng.random(3000) > 0.33)] + 0.6 * rng.normal(size=(3000, 32))
    rows = [(i, [float(x) for x in p], "x") for i, p in enumerate(points)] + [(9001, None, "x"), (9002, [0.0] * 32, "x"), (9003, [], "x")]
    vectors = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, cell STRING")
    queries = vectors.where("vec_id % 100 = 0")
    centres = vector_index.fit_centroids(vectors, sample=1000)
    found = {(r.query_id, r.vec_id) for r in vector_index.search(vectors, queries, 10, centres, block=200).collect()}
    exact = {(r.query_id, r.vec_id) for r in search.nearest_vectors(vectors, queries, 10).collect()}
    assert len(found) == len(exact) == 300
    assert len(found & exact) / len(exact) >= 0.9
    assert vector_index.into_cells(vectors, centres).count() == 3000
    assert vector_index.search(vectors.limit(0), queries, 10, vector_index.fit_centroids(vectors.limit(0))).count() == 0


def test_classes_and_large_functions_are_cut_in_every_language():
    js = "export class A extends B {\n  #x = 1;\n\n  constructor(a) {\n    super(a);\n  }\n  static async go(b) { return b; }\n  y = f(2);\n}\n"
    assert chunking.file_spans(js, "js") == [(1, 3, "class_header", "A"), (4, 6, "function", "constructor"), (7, 7, "function", "go"), (8, 9, "class_header", "A")]
    rust = "impl A {\n    pub fn f(&self) -> u8 {\n        1\n    }\n}\ntrait T {\n    fn g(&self);\n}\n"
    assert chunking.file_spans(rust, "rs") == [(1, 1, "class_header", "A"), (2, 4, "function", "f"), (5, 5, "class_header", "A"), (6, 8, "class_header", "T")]
    body = "".join(f"\tx{i} := {i}\n" for i in range(20)) + "\tif a {\n\t\tfor b {\n\t\t}\n\t}\n" + "".join(f"\ty{i} := {i}\n" for i in range(30))
    go = "package p\n\nfunc Big() {\n" + body + "}\n"
    assert [(k, n) for _, _, k, n in chunking.file_spans(go, "go")] == [("top_level", ""), ("function", "Big_part1"), ("function", "Big_part2")]
    small = "package p\n\nfunc Small() {\n\tif a {\n\t}\n}\n"
    assert chunking.file_spans(small, "go")[1] == (3, 6, "function", "Small")


def test_nearest_within_a_scope(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 3)], [None, "a", "b"][i % 3]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, repo STRING")
    found = search.nearest_vectors(vectors, vectors.where("vec_id IN (0, 1, 2)"), 4, within="repo").collect()
    scope = {i: r for i, _, r in rows}
    assert {r.query_id for r in found} == {1, 2} and all(scope[r.vec_id] == scope[r.query_id] for r in found) and len(found) == 8
    assert search.nearest_vectors(vectors, vectors.where("vec_id = 1"), 50, within="repo").count() == 9
