"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import uuid
from collections.abc import Callable
from types import ModuleType

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Below this many rows a side with one bounded row per key may be broadcast.
BROADCAST_ROWS = 20_000
#: A key is hot if it has over one in HOT_SHARE of a table's rows, and at least HOT_LEAST.
HOT_SHARE, HOT_LEAST = 1000, 2000

#: ``[^\x20\x09-\x0D]+``: the words of most operators.  ``bytes.split()`` in
#: Python splits on exactly the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of an Arrow batch while a table is written: texts are long, and two tasks share an executor.
ARROW_ROWS = 1000
ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables this session has written and not yet removed, oldest first.
_live: list[str] = []


def workspace(spark: SparkSession) -> str:
    """A fresh folder every executor can reach.

    It lies in ``spark.checkpoint.dir``; only where that is unset in the
    warehouse, and there only if all tasks run on this machine, or the
    warehouse lies on shared storage.  What is written there goes when it is
    released, or when the session's JVM ends.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir") + "/work"
        if not context.master.startswith("local") and (base.startswith("file:") or "://" not in base):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _live.append(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop(spark: SparkSession, path: str) -> None:
    """Remove a written table."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)
    if path in _live:
        _live.remove(path)


def mark() -> int:
    """What ``release`` counts from."""
    return len(_live)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Remove the tables written after ``since``, apart from those that ``keep`` reads directly."""
    held_on = {getattr(d, "_stored_at", None) for d in keep}
    for path in _live[since:]:
        if path not in held_on:
            drop(spark, path)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """SQL settings for the statements run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, path: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs its running tasks only.  The
    shuffle files behind the table go as soon as it is written.
    """
    spark = df.sparkSession
    path = path or workspace(spark)
    with settings(spark, **{FREE: "true", ARROW: str(ARROW_ROWS)}):
        w = df.write.mode("overwrite")
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def in_written_order(df: DataFrame) -> DataFrame:
    """``df``, a written table read again, in the order it was written: part by part, row by row.

    Spark deals a table's files out by size, so partitions of a plain read
    don't follow the order of the parts.  A frame that isn't a table read from
    files has no such order and stays as it is.
    """
    try:
        d = df.select(*df.columns, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return df
    number = lambda p: F.coalesce(F.regexp_extract("__file", p, 1).try_cast("bigint"), F.lit(-1))
    order = (number(r"^part-(\d+)"), number(r"-c(\d+)\."), F.col("__file"), F.col("__row"))
    return d.repartitionByRange(hash_parts(df.sparkSession), *order).sortWithinPartitions(*order).select(*df.columns)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side of ``rows`` known rows of bounded size if that is little; else Spark's own choice of join."""
    return F.broadcast(df) if rows <= limit else df


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``c``, which is computed once, also inside other functions of higher order.

    It is the end of a fold over nothing; unlike ``transform`` that copies no nested array.
    """
    return F.aggregate(F.array().cast("array<int>"), c, lambda kept, _: kept, use)


def bounded(c: Column) -> Column:
    """A string as a key of at most 100 characters: itself, or the SHA-256 of a longer one."""
    return bound(c, lambda x: F.when(F.char_length(x) <= 100, x).otherwise(F.concat(F.lit("\x00"), F.sha2(x, 256))))


class Hot:
    """Joins of a table with sides that hold few bounded rows per key, whatever share of the table one key has.

    A key with over one in HOT_SHARE of the table's rows is hot, so there are
    fewer than HOT_SHARE of them: their rows of the side are broadcast, and
    only the other keys' rows are shuffled.  A side of at most BROADCAST_ROWS
    rows is broadcast as a whole.
    """

    def __init__(self, rows: DataFrame, key: str, n_side: int | None = None):
        self.key, self.all, self.hot = key, n_side is not None and n_side <= BROADCAST_ROWS, None
        if not self.all:
            least = max(HOT_LEAST, rows.count() // HOT_SHARE)
            self.hot = stored(rows.groupBy(key).count().where(F.col("count") > least).select(key))

    def join(self, rows: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
        if self.all:
            return rows.join(F.broadcast(side), self.key, how)
        hot = F.broadcast(self.hot)
        some = rows.join(hot, self.key, "left_semi").join(F.broadcast(side.join(hot, self.key, "left_semi")), self.key, how)
        return some.unionByName(rows.join(hot, self.key, "left_anti").join(side, self.key, how))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def hash_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents by name, whatever else the table carries."""
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def held(key: str, build: Callable[[], object]):
    """What a Python worker keeps between tasks: one thing, until another operator runs in it."""
    box = sys.modules.setdefault("_worker_held", ModuleType("_worker_held"))
    if getattr(box, "key", None) != key:
        box.key, box.value = key, build()
    return box.value


def tidy(run: Callable) -> Callable:
    """A batch function that gives its memory back when its task is over.

    Spark's Python workers outlive tasks, and their memory counts against the
    executor's while other operators run.
    """

    def give_back() -> None:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    def wrapped(batches):
        sys.modules.pop("_worker_held", None)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
