"""Cutting lineage in iterative operators, in a way that outlives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a new temporary folder for local sessions where it is unset."""
    known = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known


#: Paths of the tables that operators wrote in this process and that have not been deleted yet.
WRITTEN: set[str] = set()


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``, read back with true sizes for the planner."""
    df.write.parquet(path)
    WRITTEN.add(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def cut_lineage(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written as a table into the shared folder and read back.

    ``instead_of``, a table that this function gave before, is deleted once the new one is there, so that rounds of an
    iteration do not pile up; nothing but ``df`` may need it.
    """
    table = written(df, f"{checkpoint_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}")
    if instead_of is not None:
        delete(df.sparkSession, instead_of.written_to)
    return table


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    WRITTEN.discard(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at the end of the block, the tables that were written in it, but for those given to the function that it
    yields, which gives them back. Nothing that is still to be computed may need the others."""
    before, kept = set(WRITTEN), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.written_to)
        return table

    try:
        yield keep
    finally:
        for path in sorted(WRITTEN - before - kept):
            delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that operators have written so far in this process. Results that were not written or collected
    before cannot be computed any more."""
    for path in sorted(WRITTEN):
        delete(spark, path)
