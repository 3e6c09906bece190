"""Freshness of tables and the health verdict, at a stated moment."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing(df: DataFrame, ts: str, as_of: Column, interval: str) -> DataFrame:
    """Rows of the interval that ends at `as_of`."""
    return df.where((F.col(ts) > as_of - F.expr(f"INTERVAL {interval}")) & (F.col(ts) <= as_of))


def freshness(tables: dict[str, tuple[DataFrame | Callable[[], DataFrame], str]], as_of: Column) -> DataFrame:
    """Total, rows of the last day and week, and the latest moment of every table, in one pass over each.

    A table may be given as a function that opens it; one that can't be opened has the status `error` and no figures.
    """
    figures = ("total", "last_24h", "last_7d", "latest")

    def profile(name: str, df: DataFrame, ts: str) -> DataFrame:
        since = lambda interval: F.count_if((F.col(ts) > as_of - F.expr(f"INTERVAL {interval}")) & (F.col(ts) <= as_of)).cast("bigint")
        return df.agg(
            F.count("*").alias("total"), since("24 HOURS").alias("last_24h"), since("7 DAYS").alias("last_7d"), F.max(ts).alias("latest")
        ).select(F.lit(name).alias("table_name"), "*", F.when(F.col("total") > 0, "ok").otherwise("empty").alias("status"))

    profiles, broken = [], []
    for name, (df, ts) in tables.items():
        try:
            profiles.append(profile(name, df() if callable(df) else df, ts))
        except AnalysisException:
            broken.append(name)
    if not profiles:
        raise ValueError("none of the tables can be opened")
    found = reduce(DataFrame.unionByName, profiles)
    for name in broken:
        kinds = {f.name: f.dataType for f in found.schema}
        row = found.sparkSession.range(1).select(F.lit(name).alias("table_name"), *(F.lit(None).cast(kinds[c]).alias(c) for c in figures), F.lit("error").alias("status"))
        found = found.unionByName(row)
    return found


def verdict(profile: DataFrame, core: list[str], ingested: str, as_of: Column, stale_hours: int = 48) -> DataFrame:
    """One row: `down` if no table can be opened, `degraded` if one can't, a core one is empty or the ingested one is stale, else `ok`."""
    late = F.coalesce(F.max(F.when(F.col("table_name") == ingested, F.col("latest"))) <= as_of - F.expr(f"INTERVAL {stale_hours} HOURS"), F.lit(True))
    bad = F.count_if(F.col("table_name").isin(*core) & (F.col("status") != "ok"))
    errors = F.count_if(F.col("status") == "error")
    told = profile.agg(late.alias("stale"), bad.cast("bigint").alias("core_not_ok"), errors.cast("bigint").alias("errors"), F.count("*").alias("_n"))
    found = F.when(F.col("errors") == F.col("_n"), "down").when(F.col("stale") | (F.col("core_not_ok") > 0) | (F.col("errors") > 0), "degraded").otherwise("ok")
    return told.withColumn("verdict", found).drop("_n")


def within_window(df: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Each event with the number of its key's events in the window before it, itself included, and whether it is allowed.

    A key's seconds are counted first; the counts are cut into buckets of one window's length, each with the bucket before it carried
    along, so a frame sees all it needs and no task holds more than two windows of a key. Events get their second's count
    by a join, which splits hot seconds. Events without a moment have neither count nor verdict.
    """
    timed = df.withColumn("_seconds", F.unix_timestamp(F.col(ts).cast("timestamp")))
    counts = timed.where("_seconds IS NOT NULL").groupBy(F.col(key).alias("_key"), F.col("_seconds").alias("_at")).agg(F.count("*").alias("_n"))
    bucket = F.floor(F.col("_at") / seconds)
    carried = counts.select("*", F.explode(F.array(F.struct(bucket.alias("bucket"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own")))).alias("_b"))
    w = Window.partitionBy("_key", "_b.bucket").orderBy("_at").rangeBetween(-(seconds - 1), 0)
    told = carried.withColumn("in_window", F.sum("_n").over(w)).where("_b.own").select("_key", "_at", "in_window")
    met = timed.join(told, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_seconds") == F.col("_at")), "left")
    return met.withColumn("allowed", F.col("in_window") <= limit).drop("_seconds", "_key", "_at")
