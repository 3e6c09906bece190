"""Event and signal feeds as Structured Streaming jobs; every job ends when the input at hand is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallybook.operators.dedup import keep_first


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100, pattern: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; `pattern` picks among its names."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def deduplicated(signals: DataFrame, keys: list[str], ts: str, delay: str = "2 days") -> DataFrame:
    """Each (source, id) once, with state bounded by the watermark."""
    return signals.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def per_place(signals: DataFrame, places: Column) -> DataFrame:
    """One row per place of a signal; a signal without places keeps one row."""
    return signals.select("*", F.explode_outer(places).alias("place"))


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts per tumbling window and key; late rows beyond the watermark are dropped."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Sessions of a key: a gap ends one."""
    grouped = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("session_start"), key, "n")


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there now as parquet, exactly once, and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def append_and_close(events: DataFrame, aggregate: Callable[[DataFrame], DataFrame], ts: str, path: str, checkpoint: str, markers: str) -> None:
    """Append the windows of all there is, those still open at the end too, and close the stream for good.

    A second run, from the same checkpoint, reads one more row from the folder `markers`: far in the future, with all
    else null, it moves the watermark past every window. Its own window stays open and is never written.
    """
    spark, far = events.sparkSession, F.lit("2999-12-31 00:00:00")
    empty = spark.createDataFrame([], events.schema)
    empty.write.mode("append").parquet(markers)
    query = aggregate(events.unionByName(spark.readStream.schema(events.schema).parquet(markers)))
    append_available(query, path, checkpoint)
    row = spark.range(1).select(*(far.cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema))
    row.write.mode("append").parquet(markers)
    append_available(query, path, checkpoint)


def insert_new_available(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> None:
    """Append only rows whose key the target has not: re-reading the input changes nothing."""

    def insert(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = keep_first(batch, keys, [c for c in batch.columns if c not in keys])
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
            fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(path)

    stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
