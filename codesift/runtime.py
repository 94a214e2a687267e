"""Session settings and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g", **extra: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("codesift")
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**SESSION_DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own, or in local mode a temporary one.

    A cluster must name ``spark.checkpoint.dir``; a folder of one machine would
    be lost with it, so none is made up there.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="codesift-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan of so few pieces that half of the cores or more would idle, spread over all of them by ``key``; others as they are.

    For Python work over files that do not split (one row group, say); made for
    scans, since counting the pieces of a plan with exchanges would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    pieces = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if 2 * pieces > cores else scan.repartition(cores, key)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; it goes when the application ends, however that happens, unless its JVM is killed."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def write_table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder; unlike a checkpoint, readers fetch only the columns they need.

    With ``by``, a column of few values, the table is cut into folders by it.
    """
    path = f"{scratch(df.sparkSession, name)}/data"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table of ``write_table`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {str(f).rsplit("/data/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
