"""Counters that a replayed batch leaves as they are: votes, confirmations, upvotes.

Increments are kept in a ledger, a partition for each (feed, batch). A batch that is run again overwrites its own partition
with the same rows, so a count is exact whatever fails and restarts. What many batches left is folded into a snapshot, which tells
up to which batch of each feed it counts; batches up to there count no more, replayed or not.

    path/ledger/feed=.../batch=.../   keys, n
    path/voters/feed=.../batch=.../   keys, voter: who has been counted, where a voter counts once
    path/snapshots/version=.../       keys, n, and per feed the last batch it holds (n null)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _replace(rows: DataFrame, path: str, feed: str, batch: int) -> None:
    """Write one batch's partition anew; a batch without rows leaves an empty one."""
    rows.withColumns({"feed": F.lit(feed), "batch": F.lit(batch).cast("bigint")}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feed", "batch").parquet(path)


def _ledger(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    schema = _with(columns, feed=StringType(), batch=LongType())
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _with(kinds: StructType, **more: DataType) -> StructType:
    return StructType([*kinds.fields, *(StructField(n, kind) for n, kind in more.items())])


def _kinds(df: DataFrame, names: list[str]) -> StructType:
    return StructType([df.schema[n] for n in names])


def increment(batch: DataFrame, number: int, path: str, feed: str, keys: list[str], voter: str | None = None, amount: Column | None = None) -> None:
    """Count a batch's rows (or sum their amounts) by the keys, once: repeating the call changes nothing.

    With a voter, each (keys, voter) counts once over all batches and feeds: rows whose pair another batch has counted are left
    out. A batch leaves itself out of that comparison, so a replay counts the same pairs. Rows without a voter count each.
    """
    spark = batch.sparkSession
    if voter:
        seen = _ledger(spark, f"{path}/voters", _kinds(batch, [*keys, voter])).where(~((F.col("feed") == feed) & (F.col("batch") == number)))
        known = F.struct(*keys, voter)
        named = batch.where(F.col(voter).isNotNull()).select(*keys, voter).distinct().withColumn("_pair", known)
        fresh = named.join(seen.select(known.alias("_pair")).distinct(), "_pair", "left_anti").drop("_pair")
        _replace(fresh, f"{path}/voters", feed, number)
        fresh = spark.read.parquet(f"{path}/voters").where((F.col("feed") == feed) & (F.col("batch") == number)) if not fresh.isEmpty() else fresh
        counted = fresh.select(*keys).unionAll(batch.where(F.col(voter).isNull()).select(*keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    else:
        counted = batch.groupBy(*keys).agg((F.sum(amount) if amount is not None else F.count("*")).cast("bigint").alias("n"))
    _replace(counted, f"{path}/ledger", feed, number)


def increment_available(stream: DataFrame, path: str, checkpoint: str, feed: str, keys: list[str], voter: str | None = None) -> None:
    """Count what a stream has now, and stop."""
    sink: Callable[[DataFrame, int], None] = lambda batch, number: increment(batch, number, path, feed, keys, voter)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _latest(spark: SparkSession, path: str, kinds: StructType) -> tuple[int, DataFrame]:
    """The newest whole snapshot and its version; an empty one before the first."""
    schema = _with(kinds, n=LongType(), feed=StringType(), upto=LongType())
    if not _exists(spark, f"{path}/snapshots"):
        return 0, spark.createDataFrame([], schema)
    versions = spark.read.schema(_with(schema, version=LongType())).parquet(f"{path}/snapshots")
    newest = versions.agg(F.max("version")).first()[0] or 0
    return newest, versions.where(F.col("version") == newest).select(schema.names)


def counts(spark: SparkSession, path: str, kinds: StructType) -> DataFrame:
    """The keys (of these kinds) and n: the newest snapshot and the batches after it."""
    keys = kinds.names
    _, snapshot = _latest(spark, path, kinds)
    open_batches = _ledger(spark, f"{path}/ledger", _with(kinds, n=LongType()))
    marks = snapshot.where("feed IS NOT NULL").select("feed", "upto")
    later = open_batches.join(marks, "feed", "left").where("upto IS NULL OR batch > upto")
    held = snapshot.where("feed IS NULL").select(*keys, "n")
    return held.unionAll(later.select(*keys, "n")).groupBy(*keys).agg(F.sum("n").alias("n"))


def fold(spark: SparkSession, path: str, kinds: StructType) -> None:
    """Write a new snapshot of all there is. No batch may be running; ledger folders of folded batches can be deleted after."""
    version, snapshot = _latest(spark, path, kinds)
    done = _ledger(spark, f"{path}/ledger", _with(kinds, n=LongType())).groupBy("feed").agg(F.max("batch").alias("upto"))
    marks = done.unionAll(snapshot.where("feed IS NOT NULL").select("feed", "upto")).groupBy("feed").agg(F.max("upto").alias("upto"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields]
    rows = counts(spark, path, kinds).withColumns({"feed": F.lit(None).cast("string"), "upto": F.lit(None).cast("bigint")})
    whole = rows.unionByName(marks.select(*none, F.lit(None).cast("bigint").alias("n"), "feed", "upto"))
    whole.write.parquet(f"{path}/snapshots/version={version + 1}")


def added_to(base: DataFrame, counted: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A table's counter column with the counts of its keys added; keys that it doesn't have are left out."""
    met = base.join(counted.select(*keys, F.col("n").alias("_n")), keys, "left")
    return met.withColumn(column, F.coalesce(column, F.lit(0)) + F.coalesce("_n", F.lit(0))).select(base.columns)
