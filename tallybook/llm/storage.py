"""Intermediate tables in the cluster's shared folder, and small helpers on sizes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: A side of a join is broadcast only while it has at most so many rows (of a few long columns each).
BROADCAST_ROWS = 1_000_000

#: Spark's setting by which a query's shuffle files go as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}
#: Of the pipeline that runs in this thread: tables written by its current or last stage; None outside of stages.
_of_stage: ContextVar[list[str]] = ContextVar("tables of the last stage")
_in_stage: ContextVar[bool] = ContextVar("whether a stage runs", default=False)


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; where that is unset, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = tempfile.mkdtemp(prefix="spark-")
        folder = _own[application]
    return folder.rstrip("/")


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back; and where it is."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    table, path = write_table(df)
    if _in_stage.get():
        _of_stage.get().append(path)
    return table


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def unused(name: str, columns: list[str]) -> str:
    """A column name like `name` that is none of the columns, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table for broadcast if its counted rows are within the bound, else leave the join to shuffle."""
    return df.hint("broadcast") if df.count() <= rows else df


@contextmanager
def stage(spark: SparkSession) -> Iterator[None]:
    """One stage of a pipeline whose predecessor's result has been written: the predecessor's intermediate tables are deleted.

    The stage's own tables stay until the next one begins, since its result may be computed later. Its queries' shuffle
    files go with each query; they would else stay until the driver collects its garbage.
    """
    for path in _of_stage.get([]):
        delete(spark, path)
    gc.collect()
    spark._jvm.System.gc()  # lets Spark drop the shuffle files of what is no longer referenced
    _of_stage.set([])
    running, kept = _in_stage.set(True), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, kept)
        _in_stage.reset(running)
