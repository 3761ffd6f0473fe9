"""Helpers shared by the training-data operators: shared folders, materialised tables, text access."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelens.functions import storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a new temporary one where it is unset.

    The fallback is for local sessions (tests) only; on a cluster the setting must be there.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. ``instead_of``, a table of this function that nothing but ``df``
    needs, is deleted then; ``tidelens.functions.storage.clear`` deletes all that are left.

    This cuts lineage in a way that outlives lost executors, and gives the planner true sizes, so that it
    broadcasts a table only if that is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    table = storage.written(df, fresh_path(df.sparkSession, name))
    if instead_of is not None:
        storage.delete(df.sparkSession, instead_of.written_to)
    return table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each ``by`` class, those whose ``key`` has the least hash.

    The classes are counted first; rows that are sure not to be among the least are dropped where they are read, so
    only about 1.5 * most rows of a class meet in a task, however large the class is.
    """
    counts = materialise(rows.groupBy(by).agg(F.count("*").alias("__count")), "class-counts")
    if counts.count() <= 10_000:
        counts = F.broadcast(counts)  # else the rows would be shuffled by class for this join
    rank = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = rows.join(counts, by).withColumn("__rank", rank).filter(F.col("__rank") * F.col("__count") <= 1.5 * most + 50)
    order = Window.partitionBy(by).orderBy("__rank", key)
    return near.withColumn("__turn", F.row_number().over(order)).filter(F.col("__turn") <= most).select(*rows.columns)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string column without copying; null rows have start == end."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1], offsets[1:].copy()
    if column.null_count:
        ends = np.where(np.asarray(column.is_null()), starts, ends)
    return data, starts, ends


def slices(starts: np.ndarray, ends: np.ndarray, limit: int):
    """Row ranges (a, b) whose texts hold about ``limit`` bytes together (one row at least)."""
    a, n = 0, len(starts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + limit, side="right")))
        yield a, min(b, n)
        a = min(b, n)


def give_back() -> None:
    """Returns to the system what this process has freed, which its allocators would keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` rows in an Arrow batch of the session's later jobs; whole texts are long, and each of an executor's
    tasks holds a batch in the JVM's buffers and two in Python, beside the heap. Results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, before and after which a worker gives back what it has freed: workers are kept between tasks, and what each
    stage leaves with them would add up beside the executor's heap."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return task
