"""Rankings, top-N per group, leaderboards and clamped limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.session import written

MAX_ROWS = 500


def clamped(limit: int | None, default: int = 100, most: int = MAX_ROWS) -> int:
    return max(1, min(limit or default, most))


def optional_predicates(df: DataFrame, predicates: dict[str, Callable[[str], Column]], asked: dict[str, str | None]) -> DataFrame:
    """Rows under the predicates whose parameter was given; a missing or empty one doesn't filter."""
    for name, predicate in predicates.items():
        if asked.get(name):
            df = df.where(predicate(asked[name]))
    return df


def enabled(features: dict[str, bool], feature: str, df: DataFrame) -> DataFrame:
    """The rows of a feature's query where the place has the feature, else none; unknown features are off."""
    return df if features.get(feature) else df.where(F.lit(False))


def ranked(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """All rows numbered within their group (over the whole table, for no group).

    Rows are cut into value ranges by a sort across tasks; counts of a group's rows in the ranges before give each
    range its offset, so no task holds a group.
    """
    keyed = df.withColumn("_group", F.to_json(F.struct(*group)) if group else F.lit(""))
    sorted_rows = written(keyed.sort(*group, *order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted_rows.groupBy("_group", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_group", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_group", "_part").orderBy(*order))
    numbered = sorted_rows.withColumn(rank, within).join(offsets, ["_group", "_part"])
    return numbered.select(*df.columns, (F.col(rank) + F.col("_before")).cast("int").alias(rank))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def metric_ranks(df: DataFrame, shown: list[str], metrics: list[str], n: int = 5, most: int = 10) -> DataFrame:
    """Top and bottom n rows (at most ten) of every metric: metric, side, value and the shown columns; nulls don't rank.

    Metrics become rows, so one pass over the table ranks them all; two windows per metric and side would hold a
    metric's rows in one task, so the first n are taken within tasks before they are taken over all.
    """
    rows = df.select(*shown, F.spark_partition_id().alias("_part"), F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))))).alias("metric", "value")).where("value IS NOT NULL")
    sided = rows.select("*", F.explode(F.array(F.lit("top"), F.lit("bottom"))).alias("side"))
    order = [F.when(F.col("side") == "top", -F.col("value")).otherwise(F.col("value")), *shown]
    n = max(1, min(n, most))
    local = top_per_group(sided, ["metric", "side", "_part"], order, n, "_r").drop("_r", "_part")
    return top_per_group(local, ["metric", "side"], order, n, "_r").drop("_r")


#: Boards of vendor profiles: who is on it, and the measure that ranks.
LEADERBOARDS = {
    "by_value": ("true", "total_value_lakh"),
    "by_contracts": ("true", "total_contracts"),
    "high_deduction": ("avg_deduction_pct > 15 AND total_contracts >= 3", "avg_deduction_pct"),
    "multi_ward": ("ward_count > 10", "ward_count"),
    "flagged": ("size(blacklist_flags) > 0", "total_value_lakh"),
}


def leaderboards(profiles: DataFrame, boards: list[str] | None = None, n: int = 10) -> DataFrame:
    """`board` and the first n profiles of every board asked for, in one pass: a top-k report.

    A profile is sent once for each board that it is on; within tasks Spark keeps the first n of a board only.
    """
    entries = [
        F.when(F.expr(LEADERBOARDS[b][0]), F.struct(F.lit(b).alias("board"), F.col(LEADERBOARDS[b][1]).cast("double").alias("measure")))
        for b in boards or LEADERBOARDS
    ]
    rows = profiles.select("*", F.explode(F.array_compact(F.array(*entries))).alias("_b")).select(*profiles.columns, "_b.board", "_b.measure")
    return top_per_group(rows, ["board"], [F.desc_nulls_last("measure"), F.asc("entity_id")], n, "_r").drop("_r", "measure")


def latest(df: DataFrame, keys: list[str], year: str, n: int = 1) -> DataFrame:
    """The rows of the n latest years of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(year))
    return df.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= n).drop("_r")


def search(df: DataFrame, name: str, number: str, asked: str, n: int = 8) -> DataFrame:
    """Rows whose name contains the asked text (two characters or more) or whose number it is; first n by number."""
    hit = (F.col(number).cast("string") == F.lit(asked.strip())) | (F.lit(len(asked.strip()) >= 2) & F.contains(F.lower(F.col(name)), F.lit(asked.strip().lower())))
    return df.where(hit).orderBy(number).limit(n)
