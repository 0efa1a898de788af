"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where it is on while a query is planned, Spark deletes the query's shuffle files once it has ended.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names.

    Where it names none, a local session gets a temporary folder; on a cluster executors could not share one, so that is
    an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the checkpoint folder and read again.

    Lineage ends there, lost executors cost nothing, later reads take only the columns they need, and joins see its size.
    What was shuffled and spilled on the way is deleted as soon as the table is written.
    The table stays until the session's folder is cleared, or until the :func:`scope` around it ends.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    if (paths := _written.get()) is not None:
        paths.append(path)
    before = df.sparkSession.conf.get(CLEANED, None)
    df.sparkSession.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            df.sparkSession.conf.unset(CLEANED)
        else:
            df.sparkSession.conf.set(CLEANED, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.__dict__["stored_at"] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes what :func:`stored` wrote for these tables, which nothing reads any more; other tables stay as they are."""
    for table in tables:
        if path := table.__dict__.get("stored_at"):
            remove(table.sparkSession, path)


def _at(spark: SparkSession, path: str) -> tuple:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    files, found = _at(spark, path)
    return files.exists(found)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    files, found = _at(spark, path)
    files.delete(found, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all that :func:`stored` wrote within it; results must have been written or collected by then."""
    token = _written.set([])
    try:
        yield
    finally:
        paths = _written.get()
        _written.reset(token)
        for path in paths:
            remove(spark, path)


def in_order(df: DataFrame) -> DataFrame:
    """``df`` stored, with ``n`` that ascends in the order of its rows, in ranges of ``n`` that are sorted by it.

    Spark packs the files of a table by their size when it reads them, so an order holds only as long as it is a column.
    """
    return stored(df.withColumn("n", F.monotonically_increasing_id())).repartitionByRange("n").sortWithinPartitions("n")
