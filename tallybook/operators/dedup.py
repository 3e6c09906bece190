"""Deduplication with explicit tie-breaks: every policy names a total order, so results don't depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.text import text_key


def keep_one(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key under an order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def keep_first(df: DataFrame, keys: list, ordinal: list[str]) -> DataFrame:
    return keep_one(df, keys, [F.asc_nulls_last(c) for c in ordinal])


def keep_last(df: DataFrame, keys: list, ordinal: list[str]) -> DataFrame:
    return keep_one(df, keys, [F.desc_nulls_last(c) for c in ordinal])


def keep_max(df: DataFrame, keys: list, measure: str, ordinal: list[str]) -> DataFrame:
    """The row with the largest measure (null counts as 0); among equals the first by ordinal."""
    return keep_one(df, keys, [F.desc(F.coalesce(measure, F.lit(0))), *(F.asc_nulls_last(c) for c in ordinal)])


def keep_first_text(df: DataFrame, text: str, ordinal: list[str], length: int = 60) -> DataFrame:
    """One row of those whose normalised text starts alike."""
    return keep_first(df.withColumn("text_key", text_key(F.col(text), length)), ["text_key"], ordinal)


def new_by_text(df: DataFrame, existing: DataFrame, text: str, ordinal: list[str], length: int = 60) -> DataFrame:
    """Rows whose normalised text is neither in `existing` nor earlier in the run."""
    seen = existing.select(text_key(F.col(text), length).alias("text_key")).distinct()
    return keep_first_text(df, text, ordinal, length).join(seen, "text_key", "left_anti")


def union_first(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Union by name in which a new row takes the place of an old one with its key."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
