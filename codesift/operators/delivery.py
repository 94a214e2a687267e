"""Messages delivered more than once: keep exactly one copy of each.

Identifiers are dictionary-encoded exactly: a hash picks a shard, and within
the shard each distinct identifier gets the next ordinal.  What was seen is a
bitmap over ordinals, cut into containers of 32768 bits per shard; a container
is kept as a sorted array of positions while it is sparse and as plain bits
once it is dense.  A batch selects one arrival per unseen bit; then the new
bits are joined to the stored ones and published by one rename, together with
the rows they stand for, so that a reader sees either all of a batch or none
of it, and a batch that comes again gets the rows it got before.

A table is delivered as a row of batches, slices of ``received_at`` in order,
so that the copy kept is the earliest of all.

Skew: the arrivals of one identifier are reduced to one before the shuffle
(partial aggregation), and the rows to drop are found by ``msg_id``, which is
unique, not by identifier, which may be that of a third of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesift.runtime import scratch, write_table

# What senders write instead of an identifier.
STAND_INS = ("", "-", "--", "?", "0", "n/a", "na", "nan", "nil", "none", "null", "undefined", "unknown", "missing", "tbd", "todo", "default", "empty", "test")
BLANKS = r"[\s\x{a0}\x{200b}\x{2060}\x{feff}]"
CONTAINER_BITS = 32768
SPARSE_LIMIT = 2048

KEPT = "shard INT, ordinal BIGINT, key STRING, msg_id BIGINT"
CONTAINERS = "shard INT, container BIGINT, last INT, positions ARRAY<INT>, bits BINARY, version BIGINT"


def canonical_identifier(column: Column) -> Column:
    """One spelling per identifier; null for blanks and stand-ins.

    UUIDs lose case, blanks, braces, dashes and the ``urn:uuid:`` prefix; a
    UUID of one repeated digit (nil, max) is a stand-in.  Other identifiers
    lose case and blanks only.
    """
    plain = F.lower(F.regexp_replace(column, BLANKS, ""))
    digits = F.regexp_replace(plain, r"^urn:uuid:|[{}()\-]", "")
    return (
        F.when(digits.rlike("^([0-9a-f])\\1{31}$"), F.lit(None).cast("string"))
        .when(digits.rlike("^[0-9a-f]{32}$"), digits)
        .when(plain.isin(*STAND_INS), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("="), plain))
    )


def message_key(identifier: Column, repo: Column, number: Column, commit: Column, own: Column) -> Column:
    """The key of a message.

    Without a usable identifier it is repository, number and commit; without
    a commit nothing shows that two rows are one message, so each stays.
    """
    squeeze = lambda c: F.lower(F.regexp_replace(c, BLANKS, ""))
    sha = squeeze(commit)
    fallback = F.concat_ws("|", F.coalesce(squeeze(repo), F.lit("~")), F.coalesce(number.cast("string"), F.lit("~")), sha)
    return (
        F.when(canonical_identifier(identifier).isNotNull(), F.concat(F.lit("i:"), canonical_identifier(identifier)))
        .when(sha.isNull() | (sha == ""), F.concat(F.lit("r:"), own.cast("string")))
        .otherwise(F.concat(F.lit("f:"), fallback))
    )


def arrival_order() -> Column:
    """Least is kept: the earliest, ties by ``msg_id``; a null ``received_at`` counts as latest."""
    return F.struct(F.col("received_at").isNull().alias("late"), F.col("received_at").alias("at"), F.col("msg_id").alias("msg_id"))


def first_arrivals(messages: DataFrame, *by: str) -> DataFrame:
    """(by, key, msg_id): the earliest row of each message in the batch, or in each of the batches that ``by`` tells apart."""
    key = message_key(F.col("correlation_id"), F.col("repo_name"), F.col("number"), F.col("head_sha"), F.col("msg_id"))
    return messages.select(*by, key.alias("key"), arrival_order().alias("order")).groupBy(*by, "key").agg(F.min("order").alias("first")).select(*by, "key", F.col("first.msg_id").alias("msg_id"))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


@dataclass(frozen=True)
class Seen:
    """What earlier batches delivered: the dictionary and the bitmap over it."""

    dictionary: DataFrame
    containers: DataFrame


def encode(arrivals: DataFrame, seen: Seen | None, shards: int) -> DataFrame:
    """Add (shard, ordinal, known).  Known keys keep their ordinal, new ones follow after the shard's last."""
    sharded = arrivals.withColumn("shard", shard_of(F.col("key"), shards))
    if seen is None:
        new = sharded.withColumn("known", F.lit(False)).withColumn("base", F.lit(0).cast("bigint"))
        old = None
    else:
        matched = sharded.join(seen.dictionary.select("shard", "key", "ordinal"), ["shard", "key"], "left")
        old = matched.where(F.col("ordinal").isNotNull()).withColumn("known", F.lit(True))
        # ordinals of a shard have no gaps, so its last container tells the next one
        ends = seen.containers.groupBy("shard").agg((F.max(F.col("container") * CONTAINER_BITS + F.col("last")) + 1).alias("base"))
        new = matched.where(F.col("ordinal").isNull()).drop("ordinal").join(ends, "shard", "left").withColumn("known", F.lit(False)).withColumn("base", F.coalesce("base", F.lit(0)).cast("bigint"))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy("key")).cast("bigint") - 1
    new = new.withColumn("ordinal", F.col("base") + rank).drop("base")
    columns = ["key", "msg_id", "shard", "ordinal", "known"]
    return new.select(*columns) if old is None else new.select(*columns).unionByName(old.select(*columns))


def position(ordinal: Column) -> tuple[Column, Column]:
    """Container and position within it."""
    return F.floor(ordinal / CONTAINER_BITS).cast("bigint"), F.pmod(ordinal, F.lit(CONTAINER_BITS)).cast("int")


def bit_is_set(positions: Column, bits: Column, at: Column) -> Column:
    """Whether a container, sparse or dense, holds position ``at``."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    dense = F.getbit(byte.cast("bigint"), F.pmod(at, F.lit(8)).cast("int")).cast("int")
    return F.coalesce(F.array_contains(positions, at), F.lit(False)) | F.coalesce(dense == 1, F.lit(False))


def containers_of(encoded: DataFrame) -> DataFrame:
    """The bitmap of encoded rows, one row per container: at most 32768 positions each."""
    container, at = position(F.col("ordinal"))
    return _packed(_grouped(encoded.select("shard", container.alias("container"), at.alias("at"))))


def _grouped(marks: DataFrame) -> DataFrame:
    return marks.groupBy("shard", "container").agg(F.array_sort(F.collect_set("at")).alias("at"), F.expr("bitmap_construct_agg(bitmap_bit_position(at + 1))").alias("map"), F.max("at").alias("last"))


def _packed(grouped: DataFrame) -> DataFrame:
    """``at`` is null where a container is dense already."""
    sparse = F.col("at").isNotNull() & (F.size("at") <= SPARSE_LIMIT)
    return grouped.select("shard", "container", "last", F.when(sparse, F.col("at")).alias("positions"), F.when(~sparse, F.col("map")).alias("bits"))


def positions_of(containers: DataFrame) -> DataFrame:
    """(shard, container, at) of every set bit."""
    every = F.sequence(F.lit(0), F.lit(CONTAINER_BITS - 1))
    dense = F.filter(every, lambda at: bit_is_set(F.array().cast("array<int>"), F.col("bits"), at))
    return containers.select("shard", "container", F.explode(F.when(F.col("bits").isNull(), F.col("positions")).otherwise(dense)).alias("at"))


def unite(one: DataFrame, other: DataFrame) -> DataFrame:
    """The union of two bitmaps, container by container; dense ones are joined bit by bit and never unpacked."""
    both = one.select("shard", "container", "last", "positions", "bits").unionByName(other.select("shard", "container", "last", "positions", "bits"))
    sparse = _grouped(both.where("bits IS NULL").select("shard", "container", F.explode("positions").alias("at")))
    dense = both.where("bits IS NOT NULL").select("shard", "container", F.lit(None).cast("array<int>").alias("at"), F.col("bits").alias("map"), "last")
    merged = sparse.unionByName(dense).groupBy("shard", "container")
    merged = merged.agg(F.expr("bitmap_or_agg(map)").alias("map"), F.max("last").alias("last"), F.when(F.bool_or(F.col("at").isNull()), F.lit(None)).otherwise(F.max("at")).alias("at"))
    return _packed(merged)


def select_unseen(encoded: DataFrame, seen: Seen | None) -> DataFrame:
    """The arrivals whose bit is not set yet."""
    if seen is None:
        return encoded
    container, at = position(F.col("ordinal"))
    marked = encoded.withColumn("container", container).withColumn("at", at)
    joined = marked.join(seen.containers, ["shard", "container"], "left")
    return joined.where(~bit_is_set(F.col("positions"), F.col("bits"), F.col("at"))).select(*encoded.columns)


def default_shards(spark: SparkSession) -> int:
    """Four shards per shuffle partition, so that a shard's sort stays small as the cluster grows."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def select_arrivals(arrivals: DataFrame, seen: Seen | None, shards: int) -> DataFrame:
    """(msg_id, key, shard, ordinal) of the arrivals, one per key, whose bit is not set yet."""
    return select_unseen(encode(arrivals, seen, shards), seen).select("shard", "ordinal", "key", "msg_id")


def deliver(messages: DataFrame, seen: Seen | None = None, shards: int | None = None) -> DataFrame:
    """(shard, ordinal, key, msg_id) of the copies to keep of one batch: one per message not seen before.

    ``messages`` needs msg_id (unique), received_at, correlation_id, repo_name,
    number and head_sha; other columns are ignored.  An empty table gives an
    empty result; repeated rows, nulls and stand-ins follow ``message_key``.
    """
    return select_arrivals(first_arrivals(messages), seen, shards or default_shards(messages.sparkSession))


class SeenStore:
    """Versions of ``Seen`` in a folder, and what each batch was given.

    ``CURRENT``            the number of the last published version
    ``batches/<batch>``    the version that a batch made, or tried to; ``v<n>/batch=<batch>`` names the one that did
    ``v<n>/kept``          the rows that version n let through; their keys and ordinals are its part of the dictionary
    ``v<n>/containers``    the containers that version n changed, whole

    A version writes only what it adds or changes; every ``compact`` versions
    one holds everything, so a reader opens at most that many.  A version is
    published by renaming a pointer over the old one: a job that dies before
    leaves the old version valid, and a batch that comes again after it gets
    the rows recorded for it.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, shards: int, compact: int = 32):
        self.spark, self.folder, self.shards, self.compact = spark, folder.rstrip("/"), shards, compact
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        self._overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE

    def _number(self, name: str) -> int:
        where = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(where):
            return 0
        stream = self._fs.open(where)
        try:
            return int(stream.readLong())
        finally:
            stream.close()

    def _put(self, name: str, number: int) -> None:
        """Write a number under a name, whole or not at all."""
        pending, where = self._path(f"{self.folder}/pending-{number}"), self._path(f"{self.folder}/{name}")
        self._fs.mkdirs(where.getParent())
        stream = self._fs.create(pending, True)
        stream.writeLong(number)
        stream.close()
        array = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = self._overwrite
        self._context.rename(pending, where, array)

    def version(self) -> int:
        return self._number("CURRENT")

    def recorded(self, batch: str) -> int:
        """The published version that a batch made, or 0."""
        made = self._number(f"batches/{batch}")
        return made if made <= self.version() and self._number(f"v{made}/batch={batch}") else 0

    def _parts(self, what: str, upto: int) -> list[str]:
        base = upto // self.compact * self.compact
        return [f"{self.folder}/v{n}/{what}" for n in range(max(base, 1), upto + 1)]

    def load(self) -> Seen | None:
        version = self.version()
        if not version:
            return None
        read = self.spark.read
        words = self._parts("kept", version)
        if version >= self.compact:
            words[0] = f"{self.folder}/v{version // self.compact * self.compact}/dictionary"
        every = read.schema(CONTAINERS).parquet(*self._parts("containers", version))
        last = every.groupBy("shard", "container").agg(F.max_by(F.struct("last", "positions", "bits"), "version").alias("c")).select("shard", "container", "c.*")
        return Seen(read.schema(KEPT).parquet(*words).select("shard", "ordinal", "key"), last)

    def kept(self, batch: str | None = None) -> DataFrame:
        """The rows let through: those of a batch, or of all."""
        numbers = range(1, self.version() + 1) if batch is None else [self.recorded(batch)]
        paths = [f"{self.folder}/v{n}/kept" for n in numbers if n]
        return self.spark.read.schema(KEPT).parquet(*paths) if paths else self.spark.createDataFrame([], KEPT)

    def publish(self, arrivals: DataFrame, batch: str) -> DataFrame:
        """Select from (key, msg_id), one row per key, set the new bits, and return the rows let through."""
        if self.recorded(batch):
            return self.kept(batch)
        seen, version = self.load(), self.version() + 1
        at = f"{self.folder}/v{version}"
        self._fs.delete(self._path(at), True)  # what an attempt that died left there
        select_arrivals(arrivals, seen, self.shards).write.mode("overwrite").parquet(f"{at}/kept")
        kept = self.spark.read.schema(KEPT).parquet(f"{at}/kept")
        bits = containers_of(kept)
        if seen is not None:
            touched = seen.containers if version % self.compact == 0 else seen.containers.join(bits.select("shard", "container"), ["shard", "container"], "left_semi")
            bits = unite(touched, bits)
        bits.withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(f"{at}/containers")
        if version % self.compact == 0:
            words = seen.dictionary.unionByName(kept.select("shard", "ordinal", "key")).withColumn("msg_id", F.lit(None).cast("bigint"))
            words.write.mode("overwrite").parquet(f"{at}/dictionary")
        self._put(f"v{version}/batch={batch}", version)
        self._put(f"batches/{batch}", version)
        self._put("CURRENT", version)
        return kept

    def deliver(self, messages: DataFrame, batch: int | str) -> DataFrame:
        """The rows of one batch to hand on.  Made for ``foreachBatch``: the same batch number gets the same rows, however often it comes."""
        kept = self.publish(first_arrivals(messages), str(batch))
        return messages.join(kept.select("msg_id"), "msg_id", "left_semi")


def deliver_in_order(messages: DataFrame, store: SeenStore, slices: int = 4) -> DataFrame:
    """(shard, ordinal, key, msg_id) of the earliest copy of each message, by way of ``store``.

    The table is cut into ``slices`` batches of equal spans of ``received_at``
    (null is latest), which go through the store one after the other.  The
    earliest copy lies in the first slice that has one, so what the store
    keeps is the earliest of all.
    """
    time = F.unix_micros("received_at")
    low, high = messages.agg(F.min(time), F.max(time)).first()
    span = 1 if low is None else high - low + 1
    place = F.least(F.floor((time - F.lit(low or 0)) * slices / F.lit(span)), F.lit(slices - 1)).cast("int")
    sliced = messages.withColumn("slice", F.coalesce(place, F.lit(slices - 1)))
    arrivals = write_table(first_arrivals(sliced, "slice"), "arrivals", by="slice")
    for n in range(slices):
        store.publish(arrivals.where(F.col("slice") == n).select("key", "msg_id"), f"slice-{n}")
    return store.kept()


def delivered(messages: DataFrame, slices: int = 4, shards: int | None = None) -> DataFrame:
    """(msg_id) of the copies to keep of a whole table, through a store of its own."""
    spark = messages.sparkSession
    return deliver_in_order(messages, SeenStore(spark, scratch(spark, "seen"), shards or default_shards(spark)), slices).select("msg_id")


def repeated(messages: DataFrame, slices: int = 4, shards: int | None = None) -> DataFrame:
    """(msg_id) of every row that ``delivered`` does not keep."""
    return messages.select("msg_id").join(delivered(messages, slices, shards), "msg_id", "left_anti")
