"""The k-th row of a table under a composite key, and the rows up to it in order, without sorting the rest.

Distributed quickselect: every round draws a few random pivot keys from the rows still in question and counts, in one
pass, how many of them lie below and on each pivot. The counts tell between which pivots the k-th key lies, and only the
rows between them stay in question, until a pivot is the k-th key itself. What reaches the driver is PIVOTS keys
and two counts for each, whatever the table's size. Only the rows up to the k-th key are then sorted and numbered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.storage import written

PIVOTS = 24


def below(keys: list[str], at: tuple[int, ...], inclusive: bool = False) -> Column:
    """Whether a row's key (integers, none of them null) comes before the key `at`, or is it."""
    first, *rest = (F.col(k) < F.lit(v).cast("bigint") for k, v in zip(keys, at))
    same = [F.col(k) == F.lit(v).cast("bigint") for k, v in zip(keys, at)]
    before = first
    for k, smaller in enumerate(rest, 1):
        before |= reduce(Column.__and__, same[:k]) & smaller
    return before | reduce(Column.__and__, same) if inclusive else before


def kth_key(rows: DataFrame, keys: list[str], k: int) -> tuple[int, ...] | None:
    """The k-th smallest key (from 1) of written rows, repeated keys counted each; None if there are fewer rows or k is 0."""
    if k < 1:
        return None
    left, before, turn = rows.select(*keys), 0, 0
    low = high = None
    while True:
        asked = left
        if low is not None:
            asked = asked.where(~below(keys, low, inclusive=True))
        if high is not None:
            asked = asked.where(below(keys, high))
        drawn = asked.orderBy(F.rand(turn)).limit(PIVOTS).collect()
        pivots = sorted({tuple(r) for r in drawn})
        if not pivots:
            return None
        counts = asked.agg(*(F.count(F.when(below(keys, p, inclusive), True)) for p in pivots for inclusive in (False, True))).first()
        for n, pivot in enumerate(pivots):
            under, upto = before + counts[2 * n], before + counts[2 * n + 1]
            if k <= under:
                high = pivot
                break
            if k <= upto:
                return pivot
            low, passed = pivot, upto
        if low in pivots:
            before = passed
        turn += 1


def first_in_order(rows: DataFrame, keys: list[str], k: int, eligible: Column, rank: str = "rank") -> DataFrame:
    """All written rows with `rank`: 1 to k for the first k of the eligible ones in the order of the keys, null for the others.

    Rows of equal keys are told apart by where they stand, so exactly k are numbered. The winners are sorted across tasks, and
    counts of the ranges before give every range its offset.
    """
    last = kth_key(rows.where(eligible), keys, k)
    if last is None and k > 0:
        raise ValueError("there are fewer eligible rows than asked for")
    wins = F.coalesce(eligible & below(keys, last, inclusive=True), F.lit(False)) if last else F.lit(False)
    others = rows.where(~wins).withColumn(rank, F.lit(None).cast("bigint"))
    if not last:
        return others
    placed = rows.where(wins).withColumn("_place", F.monotonically_increasing_id())
    ordered = written(placed.sort(*keys, "_place").withColumn("_range", F.spark_partition_id()))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ordered.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", offset.alias("_before"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*keys, "_place"))
    numbered = ordered.withColumn("_within", within).join(F.broadcast(sizes), "_range").withColumn(rank, F.col("_before") + F.col("_within"))
    upto = F.when(F.col(rank) <= k, F.col(rank)).cast("bigint")
    return numbered.withColumn(rank, upto).select(others.columns).unionByName(others)
