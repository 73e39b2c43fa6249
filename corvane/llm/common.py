"""Helpers shared by the operators: shared scratch tables and checked broadcasts, ranges."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F

from corvane.session import bounded as session

#: A key column is broadcast only if its rows, counted first, stay below this many bytes.
BROADCAST_BYTES = 24 << 20
#: A word: a maximal run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def uncollected() -> Iterator[None]:
    """Without Python's search for cycles: code that makes many objects and no cycles spends much of its time in it."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def gathered(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until ``column`` (strings) has ``size`` bytes; the session's bound keeps each of them small."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(column).nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session takes a temporary folder and a cluster
    a folder inside the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
        return named
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """The tables that one caller made, in order, so that it can drop them early and touch nobody else's."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def drop_but_last(self) -> None:
        """Delete all but the last, for a caller that has written all it needs into that one."""
        for path in self.paths[:-1]:
            _delete(self.spark, path)
        del self.paths[:-1]


#: Whose tables are being made in this thread.
_OWNER: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables that this thread makes inside the block are the block's own."""
    own = Scratch(spark)
    before = _OWNER.set(own)
    try:
        yield own
    finally:
        _OWNER.reset(before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends, or earlier by its owner."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if own := _OWNER.get():
        own.paths.append(path)
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except (Py4JError, OSError, AttributeError):
        pass  # the session has ended


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage so that a lost executor costs a reread, not a recomputation,
    and it lets Spark split skewed joins on both sides.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys`` (one distinct 8-byte column).

    The keys are counted; they are broadcast only below ``BROADCAST_BYTES`` and
    are shuffled with ``df`` otherwise.
    """
    if keys.count() * 32 <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is not in ``keys``, under the same rule as :func:`semi`."""
    if keys.count() * 32 <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    return df.join(keys, on, "left_anti")


def range_cuts(values: DataFrame, size: int) -> list[Row]:
    """``cut, weight, rows, own`` of consecutive ranges of ``value``, in order, which hold up to about ``size`` of ``weight`` each.

    A range ends at its ``cut``, included.  A value of ``size`` or more is a range
    of its ``own``.  Nulls are left out.  Values are summed, dealt by range and
    summed on in each part, so the driver sees a row for each range and no more.
    """
    sums = values.where(F.col("value").isNotNull()).groupBy("value").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = sums.repartitionByRange(parts, "value").withColumns({"part": F.spark_partition_id(), "own": F.col("weight") >= size})
    up_to = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(F.col("own").cast("int")).over(up_to) - F.col("own").cast("int")
    fill = F.floor((F.sum("weight").over(up_to) - F.lit(1)) / size)
    ranges = placed.withColumns({"before": before, "fill": F.when(F.col("own"), F.lit(0)).otherwise(fill)}).groupBy("part", "before", "own", "fill")
    found = ranges.agg(F.max("value").alias("cut"), F.sum("weight").alias("weight"), F.sum("n").alias("rows")).select("cut", "weight", "rows", "own")
    out: list[Row] = []
    for r in sorted(found.collect(), key=lambda r: r["cut"]):
        last = out[-1] if out else None
        if last and not (last["own"] or r["own"]) and last["weight"] + r["weight"] <= size:  # where a part began
            out[-1] = Row(cut=r["cut"], weight=last["weight"] + r["weight"], rows=last["rows"] + r["rows"], own=False)
        else:
            out.append(r)
    return out
