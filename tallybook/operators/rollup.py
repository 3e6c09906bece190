"""Roll-ups: conditional counts, pivots, totals with a grand-total row, argmax per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_where(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("bigint")


def status_pivot(df: DataFrame, keys: list[str], status: str, statuses: dict[str, str]) -> DataFrame:
    """Per key the total and a count for each status; statuses not listed count in the total only."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *(count_where(F.col(status) == value).alias(name) for name, value in statuses.items()))


def category_pivot(df: DataFrame, key: str, category: str, categories: list[str]) -> DataFrame:
    """One column per listed category, 0 where a key has none; keys without any row are absent."""
    return df.groupBy(key).pivot(category, categories).count().fillna(0)


def totals_with_all(df: DataFrame, key: str, part: str, amount: Column, label: str = "ALL") -> DataFrame:
    """Sum and count per (key, part), and a row `ALL` per key."""
    parts = df.withColumn("_amount", amount).groupingSets([[key, part], [key]], key, part)
    summed = parts.agg(F.sum("_amount").alias("total"), F.count("*").alias("entries"), F.grouping(part).alias("_all"))
    return summed.withColumn(part, F.when(F.col("_all") == 1, F.lit(label)).otherwise(F.col(part).cast("string"))).drop("_all")


def yearly_with_top(df: DataFrame, keys: list[str], new: Column, fee: Column, kind: str) -> DataFrame:
    """Per key: total, new ones and the rest, fees, and the most frequent kind (ties: first by name)."""
    per_kind = df.withColumns({"_new": new, "_fee": fee}).groupBy(*keys, kind).agg(F.count("*").alias("n"), count_where(F.col("_new")).alias("new"), F.sum("_fee").alias("fees"))
    named = F.when(F.col(kind).isNotNull(), F.struct(-F.col("n"), F.col(kind)))
    return per_kind.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum("new").alias("new"), (F.sum("n") - F.sum("new")).alias("renewed"), F.sum("fees").alias("fees"), F.min_by(kind, named).alias("top_kind")
    )


def stage_distribution(df: DataFrame, stage: str, amount: Column, top: int = 10) -> DataFrame:
    """Rows and sums by stage (blank: a dash), the most frequent first: a top-k report."""
    named = F.coalesce(F.nullif(F.trim(F.col(stage)), F.lit("")), F.lit("—"))
    return df.groupBy(named.alias("stage")).agg(F.count("*").alias("orders"), F.sum(amount).alias("amount")).orderBy(F.desc("orders"), "stage").limit(top)


def city_summary(df: DataFrame, source: str, live: str, amount: Column, year: str, vendor: str, division: str) -> DataFrame:
    """One row: live and older orders (null source is older), sum, years, vendor with the largest sum, most frequent division among live ones."""
    is_live = F.col(source).eqNullSafe(F.lit(live))
    whole = df.agg(
        count_where(is_live).alias("live"), count_where(~is_live).alias("older"), F.sum(amount).alias("amount"),
        F.array_join(F.sort_array(F.collect_set(year)), ",").alias("years"),
    )
    vendors = df.where(F.col(vendor).isNotNull()).groupBy(vendor).agg(F.sum(amount).alias("s")).agg(F.min_by(vendor, F.struct(-F.col("s"), F.col(vendor))).alias("top_vendor"))
    divisions = df.where(is_live & F.col(division).isNotNull()).groupBy(division).agg(F.count("*").alias("n")).agg(F.min_by(division, F.struct(-F.col("n"), F.col(division))).alias("top_division"))
    return whole.join(vendors).join(divisions)  # one row each


def argmax_rows(df: DataFrame, keys: list[str], measure: str, ordinal: list[str]) -> DataFrame:
    """The row with the largest measure per key; among equals the first by ordinal."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(measure), *ordinal)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def share_of_total(df: DataFrame, amount: str, *by: str) -> DataFrame:
    """Each row's percentage of its group's total, rounded half up; null for an empty total."""
    total = F.sum(amount).over(Window.partitionBy(*by))
    return df.withColumn("share_pct", F.floor(F.col(amount).cast("double") * 100 / F.nullif(total.cast("double"), F.lit(0.0)) + 0.5).cast("bigint"))


def against_average(df: DataFrame, column: str) -> DataFrame:
    """Each row beside the city's average, computed over all rows."""
    average = df.agg(F.avg(column).alias("city_average"))
    return df.join(average).withColumn("above", F.col(column) > F.col("city_average"))  # one row


def listing(df: DataFrame, group: str, element: str, missing: str = "Unassigned") -> DataFrame:
    """Sorted members of each group; null groups are listed as unassigned. Groups are dimensions."""
    named = F.coalesce(F.col(group).cast("string"), F.lit(missing)).alias("grouped")
    return df.groupBy(named).agg(F.sort_array(F.collect_set(element)).alias("members"))


def nested_years(df: DataFrame, key: str, year: str, **sums: Column) -> DataFrame:
    """Per key an array of structs, one per year in order."""
    yearly = df.groupBy(key, year).agg(*(c.alias(n) for n, c in sums.items()))
    return yearly.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(year, *sums))).alias("years"))


def unanswered(subjects: DataFrame, questions: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    """The catalogue of questions for every subject less what is answered; both catalogues are bounded dimensions."""
    return subjects.join(questions).join(answered.select(*keys).distinct(), keys, "left_anti")


def positive_categories(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key and category column with a value above zero."""
    return df.unpivot(keys, columns, "category", "amount").where("amount > 0")
