"""Structured Streaming forms of the event operators: the batch functions on streaming frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.runtime import scratch

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_table(spark: SparkSession, folder: str, name: str, schema: str, files: int = 16) -> DataFrame:
    """A stream over a table's files, ``files`` per batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if system.getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def timed(events: DataFrame, lateness: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def first_within(events: DataFrame, keys: list[str], lateness: str = "24 hours") -> DataFrame:
    """One delivery of each key within the watermark; state older than it is dropped."""
    return timed(events, lateness).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, name: str, mode: str, hand_on: Callable[[DataFrame, int], DataFrame] | None = None, timers: bool = False) -> DataFrame:
    """Run a stream over what is there and return what it wrote.

    The sink is idempotent: a batch writes its own folder, so a batch that is
    run again after a failure replaces what it wrote.  ``hand_on`` makes of a
    batch and its number the rows to write.  In complete mode the last batch
    holds the whole result.  A stream with ``timers`` of processing time would
    ask for one more batch for ever, so batches without data are switched off
    for it.
    """
    spark = stream.sparkSession
    root = scratch(spark, name)
    last = {"id": -1}

    def write(batch: DataFrame, number: int) -> None:
        (hand_on(batch, number) if hand_on else batch).write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        last["id"] = number

    switch = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(switch)
    spark.conf.set(switch, str(not timers and before == "true").lower())
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/log").foreachBatch(write).trigger(availableNow=True).start()
    spark.conf.set(switch, before)
    query.awaitTermination()
    if last["id"] < 0:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{root}/out/batch={last['id']}")
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")


def run_every(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], every: str | None = None, mode: str = "append"):
    """Start a stream as a periodic job: a batch every so often ("1 hour"), or, without ``every``, over what is there and then an end.

    ``folder`` holds the stream's log, so the job goes on where it stopped;
    ``write`` gets a batch and its number and must bear a number twice.
    """
    job = stream.writeStream.outputMode(mode).option("checkpointLocation", folder).foreachBatch(write)
    return (job.trigger(processingTime=every) if every else job.trigger(availableNow=True)).start()
