"""Cutting lineage, and broadcasts behind a checked size."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a side that is broadcast at most, as its rows are held.
BROADCAST_BYTES = 64 << 20
#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_planning, _tidy = threading.Lock(), {"depth": 0, "before": "false"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only on a local master."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if current.isEmpty():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = named or tempfile.mkdtemp(prefix="topicloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named or current.get()


@contextlib.contextmanager
def _tidying(spark: SparkSession) -> Iterator[None]:
    """Plans made inside remove their shuffle files when they have run; several threads may be inside."""
    with _planning:
        if not _tidy["depth"]:
            _tidy["before"] = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        _tidy["depth"] += 1
    try:
        yield
    finally:
        with _planning:
            _tidy["depth"] -= 1
            if not _tidy["depth"]:
                spark.conf.set(CLEANUP, _tidy["before"])


def cut(df: DataFrame, dealt: bool = False) -> DataFrame:
    """Reliable checkpoint in the session's shared folder.

    The shuffle files that led to it are removed at once: ``df`` is planned anew for that.
    ``dealt`` keeps how the rows are dealt to partitions (by ``repartition`` with a key), so
    that joins and sums by that key leave them where they are.  A plan that is made anew as
    it runs does not say so beforehand: this one is made at once.
    """
    spark, adaptive = df.sparkSession, "spark.sql.adaptive.enabled"
    shared_folder(spark)
    with _tidying(spark):
        if not dealt:
            planned = df.select("*")
        else:
            with _planning:  # another thread may plan, too
                before = spark.conf.get(adaptive)
                spark.conf.set(adaptive, "false")
                try:
                    planned = df.select("*")
                    planned._jdf.queryExecution().executedPlan()
                finally:
                    spark.conf.set(adaptive, before)
    return planned.checkpoint(eager=True)


def remove(spark: SparkSession, name: str) -> None:
    """Delete a folder of files that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(done: DataFrame) -> None:
    """Remove the files of a table that ``cut`` returned; nothing read later may rest on it."""
    remove(done.sparkSession, done._jdf.queryExecution().logical().rdd().getCheckpointFile().get())


def store(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``df`` in files of the shared folder, and their path; its shuffle files are removed at once.

    Files hold sorted numbers as packed differences and few distinct ones as packed places,
    a checkpoint holds each whole.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    with _tidying(spark):
        df.write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary#words.list.element", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, its session's Arrow batches bounded in bytes, where the session sets no bound of its own."""
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if limit not in conf.getAll:
        conf.set(limit, str(BATCH_BYTES))
    return df


def lookup(df: DataFrame, size: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """A side to join with: broadcast if its counted bytes are few."""
    return F.broadcast(df) if size <= most else df


def numbered(df: DataFrame, *order) -> DataFrame:
    """The rows (cut) in order over range partitions, with partition ``__p`` and place in it ``__i``."""
    at = F.monotonically_increasing_id()
    x = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at))
    return x.withColumn("__p", F.shiftright("__at", 33)).withColumn("__i", F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at")


def ranks(df: DataFrame, name: str, keys: list[str], *order) -> DataFrame:
    """Rank from 1 inside each key, by order; keys are not null.

    A segmented scan: rows are range-partitioned by key and order, so a key's rows lie in
    partitions in turn; one row by partition and key carries how many came before.  No task
    holds a key, however many rows it has.
    """
    x = numbered(df, *keys, *order)
    per = x.groupBy("__p", *keys).agg(F.min("__i").alias("__first"), F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition that has the key
    per = cut(per.withColumn("__before", F.coalesce(earlier, F.lit(0))).drop("__n"))
    got = x.join(lookup(per, per.count() * 24 * (2 + len(keys))), ["__p", *keys])
    return got.withColumn(name, (F.col("__i") - F.col("__first") + F.col("__before") + 1).cast("int")).drop("__p", "__i", "__first", "__before")


def dense_ids(df: DataFrame, name: str, *order) -> DataFrame:
    """Number the rows from 0 in order, without one task that sees them all.

    Rows are range-partitioned and sorted; only each partition's count reaches the
    driver.  The checkpoint makes both passes see the same partitions.
    """
    x = numbered(df, *order)
    counts = sorted(map(tuple, x.groupBy("__p").agg(F.count("*")).collect()))
    first, base = 0, []
    for p, n in counts:
        base.append((p, first))
        first += n
    starts = F.broadcast(df.sparkSession.createDataFrame(base, "__p long, __first long"))  # a row per partition
    return x.join(starts, "__p").withColumn(name, F.col("__i") + F.col("__first")).drop("__p", "__i", "__first")
