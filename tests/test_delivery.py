from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codesift.operators import delivery

SCHEMA = "msg_id BIGINT, received_at TIMESTAMP, correlation_id STRING, repo_name STRING, number INT, head_sha STRING, shard STRING, key STRING"
T = datetime(2025, 1, 1)
UUID = "8f14e45f-ceea-467f-9575-0f3a6f1c2b3d"


def messages(spark, *given):
    return spark.createDataFrame([(i, T + timedelta(seconds=s), c, r, n, h, "x", "y") for i, s, c, r, n, h in given], SCHEMA)


def test_spellings_of_an_identifier_are_one(spark, rows):
    given = [(1, 5, UUID, "a/b", 1, "c0"), (2, 1, UUID.upper(), "a/b", 1, "c1"), (3, 2, "{" + UUID + "}", None, None, None), (4, 3, "urn:uuid:" + UUID, "z", 2, "d"), (5, 4, UUID.replace("-", "") + "\n", "a", 1, "c")]
    assert rows(delivery.repeated(messages(spark, *given))) == [(1,), (3,), (4,), (5,)]


def test_stand_ins_fall_back_to_commit_and_never_join_identified_rows(spark, rows):
    nil = "00000000-0000-0000-0000-000000000000"
    given = [(1, 1, None, "a/b", 1, "C0"), (2, 2, " n/a ", "A/B", 1, "c0 "), (3, 3, nil, "a/b", 2, "c0"), (4, 0, UUID, "a/b", 1, "c0"), (5, 9, "unknown", "a/b", 1, None), (6, 9, "unknown", "a/b", 1, None)]
    assert rows(delivery.repeated(messages(spark, *given))) == [(2,)]


def test_ties_repeats_and_null_times(spark, rows):
    given = [(7, 1, "x1", "r", 1, "c"), (3, 1, "X1", "r", 1, "c"), (9, 0, "x2", "r", 1, "c")]
    df = messages(spark, *given).unionByName(messages(spark, (2, 0, "x2", "r", 1, "c")).withColumn("received_at", F.lit(None).cast("timestamp")))
    assert rows(delivery.repeated(df)) == [(2,), (7,)]


def test_empty(spark):
    assert delivery.repeated(messages(spark).limit(0)).count() == 0
    assert delivery.deliver(messages(spark)).count() == 0


def test_batches_through_the_store_keep_one_copy_of_each(spark, tmp_path):
    store = delivery.SeenStore(spark, str(tmp_path / "seen"), 3, compact=3)
    ids = [f"id-{i % 40}" for i in range(200)]
    kept = []
    for b in range(5):
        batch = messages(spark, *[(i, i, ids[i], "r", 1, "c") for i in range(b * 40 - (b > 0), b * 40 + 40)])
        kept += [r[0] for r in store.deliver(batch, b).select("msg_id").collect()]
    assert sorted(kept) == list(range(40))
    assert store.version() == 5
    seen = store.load()
    assert sorted(r.key for r in seen.dictionary.collect()) == sorted({f"i:={i}" for i in ids})
    assert seen.dictionary.select("shard", "ordinal").distinct().count() == 40
    assert delivery.positions_of(seen.containers).count() == 40 and store.kept().count() == 40


def test_a_batch_that_comes_again_gets_the_same_rows(spark, tmp_path, rows):
    store = delivery.SeenStore(spark, str(tmp_path / "seen"), 2)
    batch = messages(spark, (1, 1, "a", "r", 1, "c"), (2, 2, "a", "r", 1, "c"), (3, 2, "b", "r", 1, "c"))
    first = rows(store.deliver(batch, 7), "msg_id")
    assert first == [(1,), (3,)]
    # the sink failed after the publication: the batch is run again, by a store that knows nothing but the folder
    again = delivery.SeenStore(spark, str(tmp_path / "seen"), 2)
    assert rows(again.deliver(batch, 7), "msg_id") == first and again.version() == 1
    assert rows(again.deliver(batch, 8), "msg_id") == []


def test_a_commit_that_dies_leaves_the_old_version(spark, tmp_path, rows):
    folder = str(tmp_path / "seen")
    delivery.SeenStore(spark, folder, 2).deliver(messages(spark, (1, 1, "a", "r", 1, "c")), 0)

    class Broken(delivery.SeenStore):
        def _put(self, name, number):
            if name == "CURRENT":
                raise RuntimeError("lost")
            super()._put(name, number)

    batch = messages(spark, (3, 1, "b", "r", 1, "c"), (4, 1, "a", "r", 1, "c"))
    with pytest.raises(RuntimeError):
        Broken(spark, folder, 2).deliver(batch, 1)
    store = delivery.SeenStore(spark, folder, 2)
    assert store.version() == 1 and store.recorded("1") == 0
    assert rows(store.deliver(batch, 1), "msg_id") == [(3,)]
    # what a dead attempt left behind is written over, whichever batch comes next
    with pytest.raises(RuntimeError):
        Broken(spark, folder, 2).deliver(messages(spark, (5, 1, "z", "r", 1, "c")), 2)
    assert rows(store.deliver(messages(spark, (6, 1, "y", "r", 1, "c")), 3), "msg_id") == [(6,)]
    assert store.recorded("2") == 0
    assert rows(store.deliver(messages(spark, (5, 1, "z", "r", 1, "c")), 2), "msg_id") == [(5,)]


def test_a_version_writes_only_what_it_changes(spark, tmp_path):
    store = delivery.SeenStore(spark, str(tmp_path / "seen"), 4)
    store.deliver(messages(spark, *[(i, i, f"k{i}", "r", 1, "c") for i in range(100)]), 0)
    store.deliver(messages(spark, (200, 1, "new", "r", 1, "c"), (201, 1, "k5", "r", 1, "c")), 1)
    assert spark.read.parquet(str(tmp_path / "seen" / "v2" / "containers")).count() == 1
    assert spark.read.parquet(str(tmp_path / "seen" / "v2" / "kept")).count() == 1


def test_dense_containers_hold_the_same_bits(spark):
    many = spark.range(3000).select(F.lit(0).alias("shard"), (F.col("id") * 3).alias("ordinal"))
    packed = delivery.containers_of(many)
    assert packed.where("bits IS NOT NULL").count() == 1
    assert {r["at"] for r in delivery.positions_of(packed).collect()} == {3 * i for i in range(3000)}
    assert delivery.unite(packed, packed).select("last", "bits").collect() == packed.select("last", "bits").collect()
    one = delivery.containers_of(spark.range(5).select(F.lit(0).alias("shard"), F.col("id").alias("ordinal")))
    assert {r["at"] for r in delivery.positions_of(delivery.unite(packed, one)).collect()} == {3 * i for i in range(3000)} | {0, 1, 2, 3, 4}


def test_a_hot_message_is_one(spark):
    hot = spark.range(5000).select(F.col("id").alias("msg_id"), F.lit(T).alias("received_at"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("correlation_id"), F.lit("r").alias("repo_name"), F.lit(1).alias("number"), F.lit("c").alias("head_sha"))
    assert delivery.repeated(hot).count() == 1666
