"""Upserts and their kin on immutable tables: the result is a new DataFrame, to be written over a partition or table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.operators.dedup import keep_first, keep_one


def upsert(base: DataFrame, new: DataFrame, keys: list[str], ordinal: list[str]) -> DataFrame:
    """Rows of `base` and `new`; where a key is in both, the new row stands. Repeats within `new`: last by ordinal."""
    both = base.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    return keep_one(both, keys, [F.asc("_age"), *(F.desc_nulls_last(c) for c in ordinal)]).drop("_age")


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str], ordinal: list[str]) -> DataFrame:
    """`base` and those rows of `new` whose key it has not; repeats within `new`: first by ordinal."""
    fresh = keep_first(new, keys, ordinal).join(base.select(*keys), keys, "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def replace_partition(base: DataFrame, new: DataFrame, column: str, value) -> DataFrame:
    """Delete where column = value (nulls are kept), then insert."""
    return base.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new, allowMissingColumns=True)


def partial_upsert(base: DataFrame, new: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """Insert unknown keys; of known ones update only the listed columns. Keys are unique on both sides."""
    here = base.withColumn("_base", F.lit(True))
    there = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys), F.lit(True).alias("_there"))
    joined = here.join(there, keys, "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if f"_new_{c}" not in there.columns:
            return F.col(c)
        taken = F.col("_there") & (F.col("_base").isNull() | F.lit(c in updated))
        return F.when(taken, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*(value(c) for c in base.columns))


def expire(df: DataFrame, as_of: Column, expires: str = "expires_at", kept: str = "is_editorial", active: str = "is_active") -> DataFrame:
    """Set inactive what has expired and is not kept by an editor."""
    gone = (F.col(expires) < as_of) & ~F.coalesce(F.col(kept), F.lit(False))
    return df.withColumn(active, F.when(F.coalesce(gone, F.lit(False)), F.lit(False)).otherwise(F.col(active)))


def flag_by_pattern(df: DataFrame, name: str, patterns: list[str], flag: str, column: str = "blacklist_flags") -> DataFrame:
    """Overwrite the flags of rows whose name contains one of the patterns, whatever the case."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.contains(F.lower(F.col(name)), F.lit(p.lower()))
    return df.withColumn(column, F.when(hit, F.array(F.lit(flag))).otherwise(F.col(column)))


def flagged_counts(df: DataFrame, column: str = "blacklist_flags") -> DataFrame:
    """One row: how many there are, and how many carry a flag."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.size(F.coalesce(column, F.array().cast("array<string>"))) > 0).cast("bigint").alias("flagged"))


def write_guarded(df: DataFrame, path: str, partition: str | None = None) -> bool:
    """Overwrite a table (only the partitions at hand, if partitioned); an empty batch leaves it alone."""
    if df.isEmpty():
        return False
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    writer.parquet(path)
    return True


def changed_rows(df: DataFrame, hit: Column, **values) -> DataFrame:
    """Set columns in the rows that a condition picks: one report rejected, one approved."""
    told = F.coalesce(hit, F.lit(False))
    return df.withColumns({c: F.when(told, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def without_rows(df: DataFrame, hit: Column) -> DataFrame:
    """Delete the rows that a condition picks; where it is unknown they stay."""
    return df.where(~F.coalesce(hit, F.lit(False)))
