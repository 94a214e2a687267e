import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codesift.llm import cutting

CHUNKS = "chunk_id BIGINT, repo_name STRING, file_path STRING, chunk_index INT, chunk_type STRING, content STRING, start_line INT, max_chars INT, kind STRING"
LIMITS = "chunk_type STRING, max_chars INT, overlap_lines INT, content STRING"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab {};,\t", max_size=40), max_size=60), st.integers(5, 80), st.integers(0, 4))
def test_pieces_cover_the_text_within_the_limit(lines, limit, overlap):
    text = "\n".join(lines)
    pieces = cutting.cut_text(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b, _ in pieces) or not text
    done = 0
    for a, b, repeated in pieces:
        assert a <= done < b or not text
        assert text[a:done].count("\n") == repeated if a < done else repeated == 0
        assert repeated <= overlap
        done = b
    assert done == len(text)


def test_cuts_at_natural_boundaries_with_overlap():
    part = "def f{}(a):\n    x = 1\n    return x\n\n"
    text = "".join(part.format(i) for i in range(9))
    pieces = cutting.cut_text(text, 100, 0)
    assert all(text[a:].startswith("def ") for a, _, _ in pieces)
    for (_, b, _), (a, _, n) in zip(pieces, cutting.cut_text(text, 100, 2)[1:], strict=False):
        assert n == 2 and a <= b + 100


def test_strongest_cut_is_the_rightmost():
    import numpy as np

    random.seed(2)
    values = np.array([random.randrange(5) for _ in range(50)])
    table = cutting.StrongestCut(values)
    for _ in range(300):
        low = random.randrange(50)
        high = random.randrange(low, 50)
        window = values[low : high + 1]
        assert table.best(low, high) == low + max(i for i, v in enumerate(window) if v == window.max())


@pytest.fixture
def tables(spark):
    long = "".join(f"line {i}\n" for i in range(40))
    data = [
        (1, "r", "p", 0, "Function ", "x\ny", 0, 1, "k"), (2, "r", "p", 1, " FUNCTION", long, None, 1, "k"), (3, "r", "p", 1, "function", long, 7, 1, "k"),
        (4, "r", "p", 2, None, long, 1, 1, "k"), (5, "r", "p", 3, "odd", long, 1, 1, "k"), (6, "r", "p", 4, "function", None, 1, 1, "k"), (7, "r", "p", 5, "function", "", 1, 1, "k"), (8, "r", "q", 0, "function", "z" * 1000, 1, 1, "k"),
    ]
    return spark.createDataFrame(data, CHUNKS), spark.createDataFrame([("function", 100, 1, "c"), ("Function", 300, 2, "c"), ("empty", None, 1, "c")], LIMITS)


def test_lines_are_those_of_the_file(tables):
    chunks, limits = tables
    out = cutting.split_oversized(chunks, limits).collect()
    assert {r.chunk_id for r in out} == {2, 3, 8}
    mine = sorted((r for r in out if r.chunk_id == 2), key=lambda r: r.piece_index)
    assert mine[0].start_line == 4 and all(len(r.content) <= 100 for r in out)
    file = "x\ny\n\n" + "".join(f"line {i}\n" for i in range(40))
    lines = file.split("\n")
    for r in mine:
        assert r.content.rstrip("\n").split("\n") == lines[r.start_line - 1 : r.end_line]
    assert "".join(r.content for r in sorted((r for r in out if r.chunk_id == 8), key=lambda r: r.piece_index)) == "z" * 1000


def test_empty_tables(tables):
    chunks, limits = tables
    assert cutting.split_oversized(chunks.limit(0), limits).count() == 0
    assert cutting.cut_oversized(chunks, limits.limit(0)).count() == 0


def test_a_file_of_many_parts_is_numbered_in_blocks(spark):
    df = spark.range(40).selectExpr("id AS chunk_id", "'r' AS repo_name", "'p' AS file_path", "CAST(id AS INT) AS chunk_index", "'function' AS chunk_type", "'a\nb' AS content")
    got = {r.chunk_index: r.base for r in cutting.first_lines(df, block=7).collect()}
    assert got == {i: 1 + 3 * i for i in range(40)}


def test_lines_of_many_pieces_are_those_of_the_file(spark):
    text = "\n".join(f"line {i} of the item" for i in range(400))
    chunks = spark.createDataFrame([(1, None, "a.py", 0, "code", "x\ny", 0, 0, "k"), (2, None, "a.py", 1, "code", text, 0, 0, "k"), (3, "r", "b.py", None, "code", text, 0, 0, "k")], CHUNKS)
    limits = spark.createDataFrame([("code", 200, 2, "c")], LIMITS)
    pieces = cutting.split_oversized(chunks, limits).orderBy("chunk_id", "piece_index").collect()
    own = [p for p in pieces if p.chunk_id == 2]
    lines = ["x", "y", "", *text.split("\n")]
    assert len(own) > 40
    for p in own:
        assert p.content.rstrip("\n").split("\n") == lines[p.start_line - 1 : p.end_line]
    assert all(p.start_line is None for p in pieces if p.chunk_id == 3)
    again = {r.chunk_id: r for r in cutting.rebuilt(cutting.split_oversized(chunks, limits)).collect()}
    import hashlib

    assert again[2].text_hash == again[3].text_hash == hashlib.sha256(text.encode()).hexdigest() and again[2].longest <= 200
