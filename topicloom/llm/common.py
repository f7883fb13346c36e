"""Small helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a counted number of its rows stays below this.
BROADCAST_ROWS = 20_000

#: Tasks that the rows of one hot key are dealt to.
SALTS = 4

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of an Arrow batch that goes to Python, where the session sets no limit of its own.
BATCH_BYTES = 8 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and is local (tests, a laptop) a temporary folder is
    set; on a cluster that is an error, as executors would not share it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = named or tempfile.mkdtemp(prefix="topicloom-checkpoint-")
        sc.setCheckpointDir(named)
    return named or current.get()


class _Passing:
    """What is to go at the end of a ``passing`` block."""

    def __init__(self):
        self.paths: list[str] = []
        self.kept: list[str] = []
        self.sent: list[Broadcast] = []


_passing: contextvars.ContextVar[_Passing | None] = contextvars.ContextVar("passing", default=None)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Checkpoints that ``cut`` and broadcasts that ``send`` make inside are removed at the end.

    What is returned from inside must rest on kept checkpoints alone; a block around
    this one removes those.
    """
    own = _Passing()
    token = _passing.set(own)
    try:
        yield
    finally:
        _passing.reset(token)
        for p in own.paths:
            remove(spark, p)
        for b in own.sent:
            b.destroy()
        if (outer := _passing.get()) is not None:
            outer.paths += own.kept


def send(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of a bounded value, destroyed with the ``passing`` block it is made in."""
    sent = spark.sparkContext.broadcast(value)
    if (own := _passing.get()) is not None:
        own.sent.append(sent)
    return sent


@contextlib.contextmanager
def _tidying(spark: SparkSession) -> Iterator[None]:
    """Plans made inside remove their shuffle files when they have run."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Materialise ``df`` reliably and cut its lineage; survives lost executors.

    The shuffle files that led to it are removed at once: only the checkpoint is read
    from then on.  Whether they are is settled when a plan is made, so ``df`` is planned
    anew here, and other plans of the session keep theirs.  ``keep`` spares the result
    in ``passing``.
    """
    shared_dir(df.sparkSession)
    with _tidying(df.sparkSession):
        planned = df.select("*")
    done = planned.checkpoint(eager=True)
    if (own := _passing.get()) is not None:
        (own.kept if keep else own.paths).append(_file(done))
    return done


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and its path; for loops over joins.

    What ``cut`` returns carries the size that was estimated for its plan, and a join's is
    the product of its sides': from round to round its digits multiply, until the driver
    works on them alone.  Files have the size they have.
    """
    path = scratch_path(df.sparkSession, what)
    with _tidying(df.sparkSession):
        df.write.parquet(path)
    if (own := _passing.get()) is not None:
        own.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _file(done: DataFrame) -> str:
    return done._jdf.queryExecution().logical().rdd().getCheckpointFile().get()


def remove(spark: SparkSession, name: str) -> None:
    """Delete a folder of files that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(done: DataFrame) -> None:
    """Remove the files of a table that ``cut`` returned; nothing that is read later may rest on it."""
    name = _file(done)
    remove(done.sparkSession, name)
    if (own := _passing.get()) is not None and name in own.paths:
        own.paths.remove(name)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder for a table written between stages."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, its session's Arrow batches bounded in bytes.

    The session's bound stays set.  Without one of its own a session takes 64 MB, which
    executor and Python worker hold at once, several times over.
    """
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if limit not in conf.getAll:
        conf.set(limit, str(BATCH_BYTES))
    return df


_held: dict[str, object] = {}


def held[T](name: str, make: Callable[[], T]) -> T:
    """An object that a Python worker keeps from task to task, until a task of another kind runs in it."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def _give_back() -> None:
    """Return free memory of this Python worker to the system; its executor's share is bounded."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *keeps: str):
    """``run`` for ``mapInArrow``, in a worker that keeps only what ``keeps`` names.

    Workers are used again by later stages.  Without this each holds, beside what its
    own stage takes, the largest that any stage before it took.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in set(_held).difference(keeps):
            del _held[name]
        _give_back()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidy


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if its counted rows are few, else leave the join to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, salts: int = SALTS) -> DataFrame:
    """Inner join on ``key`` of which a value may hold a large part of ``many``.

    The rows of a value are dealt to ``salts`` tasks by the hash of their column
    ``spread``; each row of ``one`` goes to all of them.
    """
    dealt = many.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copied = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [key, "__salt"]).drop("__salt")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
