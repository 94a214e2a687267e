import hashlib
import random

from codesift.operators import trees

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaves(spark, files, repo="r"):
    return trees.leaf_hashes(spark.createDataFrame([(repo, p, t) for p, t in files.items()], "repo_name STRING, file_path STRING, text STRING"))


def by_hand(files):
    def walk(prefix):
        names = {}
        for path, text in files.items():
            if path.startswith(prefix):
                rest = path[len(prefix):]
                head = rest.split("/")[0]
                names[head] = sha(text) if "/" not in rest else walk(prefix + head + "/")
        return sha("".join(f"{n}:{h}\n" for n, h in sorted(names.items())))

    return walk("")


def test_root_hash_by_definition_and_its_changes(spark):
    files = {"a.py": "x", "src/b.py": "y", "src/deep/c.py": "z", "src/deep/d.py": ""}
    root = lambda f: trees.directory_hashes(leaves(spark, f)).where("depth = 0").first()["hash"]
    assert root(files) == by_hand(files)
    assert root({**files, "src/deep/c.py": "w"}) != root(files)
    assert trees.directory_hashes(leaves(spark, {"a": "b"}).limit(0)).count() == 0


def test_tree_diff(spark, rows):
    old, new = leaves(spark, {"a": "1", "b": "2", "d/x": "3", "gone": "4"}), leaves(spark, {"a": "1", "b": "9", "d": "3", "moved": "4"})
    assert rows(trees.tree_diff(old, new, "repo_name"), "file_path", "change") == [("b", "modified"), ("d", "added"), ("d/x", "deleted"), ("gone", "deleted"), ("moved", "added")]
    assert trees.tree_diff(old, old, "repo_name").count() == 0
    assert {r.file_path for r in trees.tree_diff(new, old, "repo_name").collect()} == {r.file_path for r in trees.tree_diff(old, new, "repo_name").collect()}


def test_subtree_counts(spark, rows):
    assert rows(trees.subtree_counts(leaves(spark, {"a/b/c": "", "a/d": "", "e": ""})), "dir", "files") == [("", 3), ("a", 2), ("a/b", 1)]


def simhash_by_hand(hashes):
    sums = [0] * 256
    for h in hashes:
        for i in range(256):
            sums[i] += 1 if int(h[i // 4], 16) >> (3 - i % 4) & 1 else -1
    return "".join(f"{sum((sums[4 * n + j] > 0) << (3 - j) for j in range(4)):x}" for n in range(64))


def test_simhash_and_hamming_by_definition(spark):
    random.seed(1)
    texts = {f"f{i}": str(random.random()) for i in range(30)}
    got = trees.simhash(leaves(spark, texts).repartition(3)).first()
    assert got["simhash"] == simhash_by_hand([sha(t) for t in texts.values()]) and got["files"] == 30
    a, b = got["simhash"], simhash_by_hand([sha(t) for t in list(texts.values())[:20]])
    want = bin(int(a, 16) ^ int(b, 16)).count("1")
    df = spark.createDataFrame([(a, b)], "a STRING, b STRING")
    assert df.select(trees.hamming(df.a, df.b)).first()[0] == want == df.select(trees.hamming(df.b, df.a)).first()[0]


def test_similar_collections_at_the_limit(spark, rows):
    base = int("f0" * 32, 16)
    flip = lambda n: f"{base ^ ((1 << n) - 1):064x}"
    df = spark.createDataFrame([("t", "a", flip(0)), ("t", "b", flip(25)), ("t", "c", flip(51)), ("u", "d", flip(0)), ("t", "e", flip(0))], "tenant STRING, repo_name STRING, simhash STRING")
    assert rows(trees.similar_collections(df, "tenant"), "repo_name_a", "repo_name_b", "distance") == [("a", "b", 25), ("a", "e", 0), ("b", "e", 25)]
    assert rows(trees.nearest_collection(df, "tenant"), "repo_name", "nearest", "distance") == [("a", "e", 0), ("b", "a", 25), ("e", "a", 0)]


def test_file_texts_join_distinct_parts(spark):
    df = spark.createDataFrame([("r", "p", 1, "b"), ("r", "p", 0, "a"), ("r", "p", 0, "a")], "repo_name STRING, file_path STRING, chunk_index INT, content STRING")
    assert trees.file_texts(df).first()["text"] == "a\n\nb"
