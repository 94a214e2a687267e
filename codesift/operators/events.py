"""Event intake: repeated deliveries in a time limit, routing, retries, dead letters, and telemetry.

The functions take static and streaming frames alike where they keep no order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Waits between attempts in seconds, and the bounds of latency buckets.
WAITS = (30, 60, 120)
BOUNDS = (5, 10, 30, 60, 120, 300, 600)
PERMANENT_CODES = (401, 403, 404, 422)
PERMANENT_ERRORS = ("ValidationError", "JSONDecodeError", "ValueError", "TypeError", "KeyError", "AttributeError")


def _first_within(key: str, identity: str, seconds: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, opened = None, 0
        for batch in batches:
            kept = []
            for k, t, i in zip(batch[key], batch["t"], batch[identity], strict=True):
                if k != current or t - opened >= seconds * 1_000_000:
                    current, opened = k, t
                    kept.append(i)
            yield pd.DataFrame({identity: pd.Series(kept, dtype=batch[identity].dtype)})

    return run


def within_limit(deliveries: DataFrame, key: str, at: str, identity: str, seconds: int = 86_400) -> DataFrame:
    """First deliveries: of a key within ``seconds`` of the delivery that opened its time, only that one.

    A key seen again after its time has run out is new.  Rows without a key
    pass.  Whether a delivery opens a new time depends on the one before, so a
    key's deliveries are read in order, one after the other, from a sorted
    partition; nothing of a key is kept but the time it was opened.  The rows
    are spread by a hash of the key, an exchange that no join before can stand
    in for, so that a join split over tasks cannot tear a key.
    """
    keyed = deliveries.where(F.col(key).isNotNull()).select(key, F.unix_micros(F.col(at)).alias("t"), identity)
    kind = dict(deliveries.dtypes)[identity]
    kept = keyed.repartition(F.xxhash64(key, F.lit(11))).sortWithinPartitions(key, "t", identity).mapInPandas(_first_within(key, identity, seconds), f"{identity} {kind}")
    return kept.unionByName(deliveries.where(F.col(key).isNull()).select(identity))


def attempt_schedule(failures: DataFrame, key: str, at: str, identity: str) -> DataFrame:
    """(identity, attempt, wait_s, total_s, dead): the wait after each failure of a key; past the last wait it is dead."""
    order = Window.partitionBy(key).orderBy(at, identity)
    rows = failures.withColumn("attempt", F.row_number().over(order))
    wait = F.when(F.col("attempt") <= len(WAITS), F.element_at(F.array(*[F.lit(w) for w in WAITS]), F.least(F.col("attempt"), F.lit(len(WAITS)))))
    rows = rows.withColumn("wait_s", wait)
    return rows.select(identity, key, F.col("attempt").cast("bigint").alias("attempt"), "wait_s", F.sum("wait_s").over(order).alias("total_s"), F.col("wait_s").isNull().alias("dead"))


def error_class(error: Column) -> Column:
    """What stands before the first colon."""
    return F.when(F.coalesce(error, F.lit("")) == "", "unknown").otherwise(F.trim(F.split(error, ":", 2)[0]))


def routed(deliveries: DataFrame, trigger: str = "/review", seconds: int = 86_400) -> DataFrame:
    """(delivery_id, key, status): what becomes of each delivery.

    ``deliveries`` has delivery_id, key (the sender's id, or null), at, valid
    (its signature), event, action, comment and on_pull (the comment stands
    on a pull request).  In this order: a bad signature is rejected; events
    that ask for nothing are ignored; of those that do, one of a key within
    ``seconds`` is accepted and the others are duplicates.
    """
    asked = F.coalesce(F.lower("comment"), F.lit("")).contains(trigger) & F.coalesce("on_pull", F.lit(False))
    wants = ((F.col("event") == "issue_comment") & (F.col("action") == "created") & asked) | ((F.col("event") == "pull_request") & F.col("action").isin("opened", "synchronize"))
    marked = deliveries.withColumn("route", F.when(~F.coalesce("valid", F.lit(False)), "rejected").when(~F.coalesce(wants, F.lit(False)), "ignored"))
    open_ = marked.where("route IS NULL")
    first = within_limit(open_, "key", "at", "delivery_id", seconds).withColumn("first", F.lit(True))
    told = marked.join(first, "delivery_id", "left")
    return told.select("delivery_id", "key", F.coalesce("route", F.when(F.col("first"), "accepted").otherwise("duplicate")).alias("status"))


def is_permanent(error: Column, code: Column) -> Column:
    """Whether a failure is not worth another attempt: bad input, or an answer that stays the same."""
    return F.coalesce(error.isin(*PERMANENT_ERRORS), F.lit(False)) | F.coalesce(code.isin(*PERMANENT_CODES), F.lit(False))


def parsed_letters(letters: DataFrame, schema: str, text: str = "letter") -> DataFrame:
    """The letters with ``body``, by ``schema``; null where the text is no JSON object."""
    return letters.withColumn("body", F.when(F.trim(text).startswith("{"), F.from_json(text, schema)))


def page(letters: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of a listing: offset and limit are what the caller asks for."""
    return letters.orderBy(*order).offset(offset).limit(limit)


def at_index(letters: DataFrame, order: list[Column], index: int) -> DataFrame:
    """The letter at ``index`` of the listing, counted from 0: found as a top-k."""
    return letters.orderBy(*order).offset(index).limit(1)


def without_index(letters: DataFrame, order: list[Column], index: int, key: str) -> DataFrame:
    """The listing less the letter at ``index``, removed by its unique ``key``."""
    return letters.join(at_index(letters, order, index).select(key), key, "left_anti")


def replayed(letters: DataFrame, order: list[Column], key: str, body: str, index: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages to send again, letters that stay) for the letter at ``index``, or for all.

    A letter without a readable ``body`` cannot be sent again and stays.
    """
    chosen = letters if index is None else at_index(letters, order, index)
    sent = chosen.where(F.col(body).isNotNull())
    return sent, letters.join(sent.select(key), key, "left_anti")


def histogram(values: DataFrame, keys: list[str], value: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """(keys, le, count): cumulative counts per bound; the last bound, infinity, is null.

    Each row is counted in one bucket before the shuffle; the running sum goes over buckets.
    """
    bucket = F.expr("CASE " + " ".join(f"WHEN {value} <= {b} THEN {i}" for i, b in enumerate(bounds)) + f" ELSE {len(bounds)} END")
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys).agg(*[F.count_if(bucket <= i).alias(f"b{i}") for i in range(len(bounds) + 1)])
    cells = F.array(*[F.struct((F.lit(float(bounds[i])) if i < len(bounds) else F.lit(None).cast("double")).alias("le"), F.col(f"b{i}").alias("count")) for i in range(len(bounds) + 1)])
    return counted.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.le", "c.count")


def in_flight(spans: DataFrame, keys: list[str], start: str, end: str, bucket_seconds: int = 3_600) -> DataFrame:
    """(keys, most, at): the largest number of open spans and the first time it is reached; ends go before starts.

    A key may be that of all rows, so its running sum goes over the totals of
    buckets of time first, and then within each bucket.  Keys may be null.
    """
    marks = spans.select(*keys, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(spans.select(*keys, F.col(end).alias("t"), F.lit(-1).alias("d")).where("t IS NOT NULL")).where("t IS NOT NULL")
    net = marks.groupBy(*keys, "t", "d").agg(F.sum("d").alias("sum")).withColumn("bucket", F.floor(F.unix_micros("t") / (bucket_seconds * 1_000_000)))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = net.groupBy(*keys, "bucket").agg(F.sum("sum").alias("total")).withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("bucket").alias("_bucket"), "before")
    inside = Window.partitionBy(*keys, "bucket").orderBy("t", "d")
    local = net.withColumn("local", F.sum("sum").over(inside))
    same = F.col("bucket") == F.col("_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    level = local.join(totals, same).withColumn("open", F.col("before") + F.col("local"))
    best = F.max(F.struct("open", (-F.unix_micros("t")).alias("at")))
    return level.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.open").alias("most"), F.timestamp_micros(-F.col("b.at")).alias("at"))


def per_window(events: DataFrame, at: str, length: str, slide: str | None, keys: list[str]) -> DataFrame:
    """Counts and sums per time window and keys; tumbling, or sliding with ``slide``."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return events.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), *keys, "events", "total")


def sessions(events: DataFrame, at: str, gap: str, key: str) -> DataFrame:
    return events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def latest_per_key(rows: DataFrame, key: str, value: str, at: str, identity: str) -> DataFrame:
    """The value last written under each key."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(at, identity)).alias(value))


def expired(rows: DataFrame, at: str, now: Column, seconds: int) -> DataFrame:
    return rows.where(F.unix_micros(at) < F.unix_micros(now) - seconds * 1_000_000)
