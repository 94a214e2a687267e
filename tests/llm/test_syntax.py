import pytest

from codesift.llm import indents, lexing, syntax

GOOD = {
    "py": ["x = 1\n", "", "def f(a, *, b=2):\n    return f'{a[\"k\"]}'\n", 's = """<<<<<<< HEAD\n"""\n'],
    "js": [
        "const a = b / c / d;", "x.replace(/[({]a/g, 'b').map((y) => ({ y, z: 1 }));", "a = `x ${ {b: `in`}.b } }`;", "class A extends B { static #x = 1; get y() { return 1 } async *z() {} }", "for (const [k, v] of m) { if (k) continue; else break }",
        "label: while (true) { do { x++ } while (x < 3) }", "export default async function () { await f?.(1)?.[2] }", "let async = 1, of = 2\nasync\nof = async", "switch (a) { case 1: default: b() }", "import a, { b as c } from 'x'\nexport * as d from \"y\"", "const el = <div a={b}>text {x} <b/></div>;", "try { f() } catch { g() } finally { }", "if (a) b; else c\nvar f = function g() {}", "#!/usr/bin/env node\nx()", "a ? b : c ? d : e; new Foo; new a.B(1).c",
    ],
    "ts": [
        "const x: Array<Foo | null> = f<Foo>(a, 1);", "export function f<T extends K>(a?: T, ...b: number[]): a is Foo { return a as unknown as T }", "interface A<T> extends B { x?: number; readonly [k: string]: T; m(a: T): void; new (a: T): A<T> }", "type F = (a: number) => Map<string, Array<Set<X>>>;", "enum E { A = 1, B }", "declare module 'x' { export const y: number }", "abstract class A<T> implements B { private readonly a: T; constructor(public b = 1) { super() } abstract m(): void }", "const f = async (a: A): Promise<void> => { a! };", "let x = a < b && c > d; type G = A extends B ? C : D[number]",
    ],
    "go": [
        "package a\nimport (\n\tx \"y\"\n)\nfunc (s *T) F(a, b int, c ...string) (r []int, err error) {\n\tfor i, v := range a {\n\t\tif x, ok := m[v]; ok && x > 1 {\n\t\t\tgo func() { defer f() }()\n\t\t}\n\t}\n\tswitch y := x.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase m := <-ch:\n\t\tf(m)\n\t}\n\treturn &T{A: 1, B: []int{1, 2}}, nil\n}\ntype T struct {\n\tA int `json:\"a\"`\n\t*B\n}\ntype I interface{ F() int }\nvar m = map[string][]int{\n\t\"a\": {1, 2},\n}\n",
        "package a\nfunc Map[T any](x []T) {}\nconst (\n\tA = iota\n\tB\n)\n",
    ],
    "rs": [
        "use a::{b, c::*};\n#[derive(Debug)]\npub struct S<'a, T: Clone + 'a>(pub &'a T) where T: Copy;\nimpl<'a> S<'a> { pub fn f(&mut self, x: u32) -> Result<Vec<Vec<u8>>, E> { let v: Vec<_> = x.iter().filter(|x| x.a > 1).collect::<Vec<_>>(); if let Some(y) = v.get(0) { return Err(E::new(\"a\")); } match x { 1..=3 | 7 => {} Foo { a, .. } if a > 1 => b(), _ => c!(\"{}\", x), } for i in 0..n { v[i] += 1; } Ok(S { a: 1, ..d }) } }",
        "fn f<'a>(x: &'a [S]) -> Option<&'a S> { let c = 'x'; let s = r#\"a \"quote\" {\"#; loop { break 'l; } unsafe { *p = 1 }; Some(&x[0]) }\nmacro_rules! m { ($x:expr) => { $x } }\nconst A: [u8; 3] = [1, 2, 3];",
    ],
}
BAD = {
    "py": ["def f(:\n", "x = (1\n", "<<<<<<< HEAD\nx = 1\n", 's = """a\n', "if a\n    b\n"],
    "js": ["function f( {", "a = 'b\n'", "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> x", "Binary content omitted", "const x: number = 1;", "a = `b", "/* a", "if (a { b }", "x = 1 }", "def f(a):\n    return a", "5fe9e33", "a ? b"],
    "ts": ["fn f(a: &str) -> u32 { 1 }", "interface { x }", "const = 1;", "@@ -1,2 +1,3 @@\nconst a = 1;"],
    "go": ["func f() {}", "package a\nfunc f( {\n}", "package a\nx := 1\n", "package a\nimport \"x\"\nfunc f() {\n\treturn f(\n}\n", "package a\nvar s = `a", "package a\nfunc f() {}\nimport \"x\"\n"],
    "rs": ["fn f() { let x = ; }", "fn f( { }", "const x = f(a);", "fn f() -> { }", "let x = 1;", "pub fn f() { a b }", "fn f() { \"a }"],
}


@pytest.mark.parametrize("lang", list(GOOD))
def test_well_formed(lang):
    for text in GOOD[lang]:
        if not (lang == "go" and not text):
            assert syntax.well_formed(text, lang), text


@pytest.mark.parametrize("lang", list(BAD))
def test_malformed(lang):
    for text in BAD[lang]:
        assert not syntax.well_formed(text, lang), text


def test_maps_compose_to_the_map_of_the_whole():
    text = "a = { b: [1, `x ${y}\n z`] };\n/* c\n } */ f(\n'q', /[(]/);\n}"
    lines = text.split("\n")
    total = None
    for line in lines:
        _, steps, _ = syntax.chunk_map(line + "\n", "js", False)
        step = {s[0]: s[1:] for s in steps}
        total = step if total is None else syntax.compose(total, step)
    whole = {s[0]: s[1:] for s in syntax.chunk_map(text + "\n", "js", False)[1]}
    assert total["comment"][0] == whole["comment"][0]
    a, b, c = ("", "({"), ("}", "["), ("])", "(")
    assert lexing.join_brackets(lexing.join_brackets(a, b), c) == lexing.join_brackets(a, lexing.join_brackets(b, c)) == ("", "(")


def test_files_over_chunks(spark, rows):
    data = [
        ("r", "a.js", 0, "class A {"), ("r", "a.js", 1, "f(x) { return 1; }"), ("r", "a.js", 2, "}"), ("r", "b.js", 0, "class A {"), ("r", "b.js", 1, "f() {}"), ("r", "c.py", 0, "def f():"), ("r", "c.py", 1, "    return 1"), ("r", "c.py", 1, "    return 1"),
        ("r", "d.py", 0, "def f():"), ("r", "d.py", 1, "return 1 +"), ("r", "e.md", 0, "def ("), ("r", None, 0, "x"), ("r", "f.ts", 0, None), ("r", "g.go", 0, None), ("r", "h.js", 0, "const a = `x"), ("r", "h.js", 1, "y`;"), ("r", "i.js", 0, "/* open"), ("r", "i.js", 1, "still"),
    ]
    df = spark.createDataFrame(data, "repo_name STRING, file_path STRING, chunk_index INT, content STRING").selectExpr("*", "'z' AS lang", "1 AS whole", "file_path AS steps")
    assert rows(syntax.malformed_files(df), "file_path") == [("b.js",), ("d.py",), ("g.go",), ("i.js",)]
    rates = {r.lang: (r.files, r.malformed, r.rate) for r in syntax.malformed_rates(df).collect()}
    assert rates["js"] == (4, 2, 0.5) and rates["py"] == (2, 1, 0.5)
    assert syntax.malformed_files(df.limit(0)).count() == 0


def test_a_file_of_more_chunks_than_a_block(spark):
    n = 2 * syntax.BLOCK + 5
    data = [("r", "x.js", i, "f({" if i == 0 else "})" if i == n - 1 else f"a{i}: 1,") for i in range(n)] + [("r", "y.js", i, "f({" if i == 0 else "a: 1,") for i in range(n)]
    df = spark.createDataFrame(data, "repo_name STRING, file_path STRING, chunk_index INT, content STRING").repartition(5)
    assert [r.file_path for r in syntax.malformed_files(df).collect()] == ["y.js"]


EMBEDDED_GOOD = {
    "js": ["a = `${f(a)} ${ {b: [1]}.b } ${`in ${x}`}`;", "const el = <ul {...p} a={f(x)} b='it' c=<i/>>don't {items.map((x) => <li key={x.id}>{x.name}</li>)} {/* note */} {...more}<></></ul>;", "const f = () => (\n  <a.B c-d={`x ${y}`} /* e */ f>\n    {ok && <b>{x ? <i/> : null}</b>}\n  </a.B>\n);"],
    "tsx": ["const f = <T extends A>(a: T) => <p>{a as B}</p>;", "type F = <T>(x: { a: T }) => void;\nconst x = <Foo<string> a={(b: C) => b!} />;", "const g = <T,>(a: Array<T>): void => { h<T>(a) };"],
    "ts": ["const x = <Foo>y;", "const s = `${a as B} ${c!}`;"],
}
EMBEDDED_BAD = {
    "js": ["a = `${f(a}`;", "a = `${f[a)}`;", "a = `${}`;", "a = `${a b}`;", "a = `${`${}`}`;", "a = `${a;}`;", "x = <p>{items.map(x => )}</p>;", "x = <p>{x}}</p>;", "x = <p>a > b</p>;", "x = <p>{f(x}</p>;", "x = <p a={}>y</p>;", "x = <p {a}>y</p>;", "x = <p>{<b>{`${}`}</b>}</p>;", "x = <p>y</q>;", "x = <p>y", "const x = <p>{a as B}</p>;"],
    "tsx": ["x = <p>{items.map(x => )}</p>;", "x = <p>{x}}</p>;", "x = <p>{x};", "const x = <Foo>y;"],
    "ts": ["const s = `${a as}`;", "const s = `${f(a}`;"],
}


@pytest.mark.parametrize("lang", list(EMBEDDED_GOOD))
def test_embedded_expressions(lang):
    for text in EMBEDDED_GOOD[lang]:
        assert syntax.well_formed(text, lang), text
    for text in EMBEDDED_BAD[lang]:
        assert not syntax.well_formed(text, lang), text


def test_deeply_nested_elements_are_tried_once():
    assert not syntax.well_formed("x = " + "<p>{f(" * 40, "js")
    assert syntax.well_formed("x = " + "<p>{f(" * 40 + "1" + ")}</p>" * 40, "js")


def test_embedded_expressions_over_chunks(spark, rows):
    data = [
        ("a.js", 0, "const a = () => <p>"), ("a.js", 1, "don't {x.map((y) => <b>{y}</b>)}"), ("a.js", 2, "</p>;"), ("b.js", 0, "const a = () => <p>"), ("b.js", 1, "{x.map(y => )}"), ("b.js", 2, "</p>;"),
        ("c.ts", 0, "const a = `x ${f("), ("c.ts", 1, "b)} y`;"), ("d.ts", 0, "const a = `x ${f("), ("d.ts", 1, "b} y`;"), ("e.jsx", 0, "const a = <p>{`${f(a}`}</p>;"), ("f.tsx", 0, "const a = `x"), ("f.tsx", 1, "${b} y`;"),
    ]
    df = spark.createDataFrame([("r", *d) for d in data], "repo_name STRING, file_path STRING, chunk_index INT, content STRING")
    assert rows(syntax.malformed_files(df), "file_path") == [("b.js",), ("d.ts",), ("e.jsx",)]


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_no_plan_tears_a_file(spark, rows):
    """With joins split over tasks, the files are told as without."""
    good = ["function f(x) {", *[f"f({i}, '{'y' * 300}');" for i in range(30)], "}"]
    data = [("big" if i % 3 else f"r{i}", f"{i}.js", at, text) for i in range(40) for at, text in enumerate(good if i % 5 else good[:-1])]
    df = spark.createDataFrame(data, "repo_name STRING, file_path STRING, chunk_index INT, content STRING").repartition(13)
    expected = rows(syntax.malformed_files(df))
    assert len(expected) == 8
    before = {k: spark.conf.get(k, None) for k in SKEW}
    try:
        for k, v in SKEW.items():
            spark.conf.set(k, v)
        assert rows(syntax.malformed_files(df)) == expected
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_files_of_a_null_repository_are_told(spark, rows):
    data = [(None, "a.js", 0, "class A {"), (None, "a.js", 1, "f() { g( }"), (None, "b.js", 0, "class A {"), (None, "b.js", 1, "}")]
    df = spark.createDataFrame(data, "repo_name STRING, file_path STRING, chunk_index INT, content STRING")
    assert rows(syntax.malformed_files(df)) == [(None, "a.js", "js")]


PYTHON = {
    ("class A:\n    x = 1", "    def f(self):\n        return 1", "def g():\n    pass"): True,
    ("class A:\n    x = 1", "        def f(self):\n            return 1"): None,
    ("if x:\n    y = 1", "else:\n    y = 2"): None,
    ("match x:\n    case 1:\n        y = 1", "    z = 1"): None,
    ('s = """a', 'b"""'): None,
    ("f(1,", "2)"): None,
    ("f(1,", "2]"): False,
    ("f(1,", "2"): False,
    ("x = f'{a[\"(\"]}' + f'{b!r:>{w}}'", "y = 1 # it's ("): True,
    ("x = 'a", "b'"): False,
    ("    x = 1",): None,
    ("", "# only ( a comment"): True,
}


@pytest.mark.parametrize("chunks", list(PYTHON))
def test_python_maps_tell_or_ask_for_the_whole_file(chunks):
    total, summary = None, ([], [])
    for text in chunks:
        stands, steps, own = syntax.chunk_map(text, "py", False)
        summary = indents.join_indents(summary, own if stands else None)
        step = {s[0]: s[1:] for s in steps}
        total = step if total is None else syntax.compose(total, step)
    code = total["code"]
    told = None if code[0] == indents.UNSURE else False if code != ("code", "", "") else True if summary is not None and summary[0] in ([], [0]) else None
    assert told == PYTHON[chunks]
    assert told is None or told == syntax.well_formed("\n\n".join(chunks), "py")


def test_indentation_summaries_are_associative():
    a, b, c, d = ([0], [0, 4, 8]), ([4], [4, 8]), ([8], [8, 12]), ([4, 0], [0])
    join = indents.join_indents
    assert join(join(join(a, b), c), d) == join(a, join(b, join(c, d))) == ([0], [0])
    assert join(a, ([6], [6])) is None and join(([], []), b) == b and join(b, ([], [])) == b


def test_depth_decides_only_where_compilers_give_up():
    for n, fine in ((4000, True), (250_000, False)):
        for text, lang in (("f(" * n + "1" + ")" * n + ";", "js"), ("x = " + "`${" * n + "1" + "}`" * n, "ts"), ("x = " + "<p>{" * n + "1" + "}</p>" * n, "jsx"), ("package a\nvar x = " + "(" * n + "1" + ")" * n, "go"), ("fn f() {" + "{" * n + "}" * n + "}", "rs")):
            assert syntax.well_formed(text, lang) == fine, (lang, n)
            assert syntax.chunk_map(text, lang, True)[0] == fine, (lang, n)
    assert not syntax.well_formed("f(" * 4000 + "1 2" + ")" * 4000 + ";", "js")
