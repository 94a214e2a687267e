from codesift.operators import diffs

DIFF = """diff --git a/lib/x.py b/lib/x.py
--- a/lib/x.py
+++ b/lib/x.py
@@ -1,3 +1,4 @@ def f
 keep
-gone
+++ b/looks like a header
+added
 keep
@@ -20,2 +30,2 @@
 c
+d
\\ No newline at end of file
diff --git a/old.py b/old.py
--- a/old.py
+++ /dev/null
@@ -1,2 +0,0 @@
-x
-y
diff --git a/n.go b/n.go
--- /dev/null
+++ b/n.go
@@ -0,0 +1,2 @@
+one
+two"""


def pr(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id BIGINT, diff STRING")


def test_lines_and_numbers(spark, rows):
    lines = diffs.diff_lines(pr(spark, DIFF), "id")
    assert rows(lines.where("file_path = 'lib/x.py' AND kind <> '-'"), "new_line", "content") == [(1, "keep"), (2, "++ b/looks like a header"), (3, "added"), (30, "c"), (31, "d"), (4, "keep")]
    assert {r.file_path for r in lines.collect()} == {"lib/x.py", "n.go"}
    assert rows(diffs.islands(diffs.valid_lines(lines, "id"), ["id", "file_path"], "new_line"), "file_path", "first", "last") == [("lib/x.py", 1, 4), ("lib/x.py", 30, 31), ("n.go", 1, 2)]


def test_ranges_merge(spark, rows):
    df = spark.createDataFrame([("f", 50, 60), ("f", 100, 101), ("f", 300, 301), ("g", 1, 2)], "f STRING, first INT, last INT")
    assert rows(diffs.widen(df, ["f"], 30)) == [("f", 20, 131), ("f", 270, 331), ("g", 1, 32)]


def test_nothing_from_null_or_empty(spark):
    assert diffs.diff_lines(pr(spark, None, ""), "id").count() == 0
    assert diffs.diff_lines(pr(spark, "x").limit(0), "id").count() == 0


def test_split_and_annotate(spark):
    parts = {r.file_path: r.patch for r in diffs.split_by_file(pr(spark, DIFF), "id").collect()}
    assert parts["n.go"].startswith("diff --git a/n.go") and parts["n.go"].endswith("+two")
    text = {r.file_path: r.annotated for r in diffs.annotated(diffs.diff_lines(pr(spark, DIFF), "id"), "id").collect()}
    assert text["n.go"] == "  L   1 [+] one\n  L   2 [+] two"
    assert "       [-] gone" in text["lib/x.py"]


def test_greedy_fold_skips_without_counting(spark, rows):
    df = spark.createDataFrame([("p", i, s) for i, s in enumerate([5, 9, 4, 1, 1])], "p STRING, i INT, s INT")
    assert rows(diffs.fitting(df, "p", "i", "s", 10)) == [("p", 0), ("p", 2), ("p", 3)]


def test_comments_split_in_two(spark, rows):
    valid = spark.createDataFrame([("r", 1, "f", 3)], "repo_name STRING, pr_number INT, file_path STRING, new_line INT")
    comments = spark.createDataFrame([(1, "r", 1, "f", 3), (2, "r", 1, "f", 4), (3, "r", 1, "f", None)], "id INT, repo_name STRING, pr_number INT, file_path STRING, line_number INT")
    assert rows(diffs.on_valid_lines(comments, valid), "id") == [(1,)]
    assert rows(diffs.on_valid_lines(comments, valid, keep=False), "id") == [(2,), (3,)]
