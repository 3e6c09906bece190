"""Connected components by alternating large-star and small-star steps, all as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.storage import written


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of an undirected edge list; the root is the component's smallest node.

    Each round halves the distance to the root or better, so rounds grow with the logarithm of a component's
    diameter. With `rounds` given, no more are made: nodes of one root are then of one component, but a component may
    still have several roots. Self-loops and repeated edges are ignored; no edges give no rows.
    """
    edges = written(edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high <> low").distinct())
    state, made = None if rounds else _state(edges), 0
    while True:
        # Large star: larger neighbours point to the smallest node around.
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("near")).unionAll(edges.select("low", "high"))
        least = both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("least"))
        wide = both.where("near > node").join(least, "node").select(F.col("near").alias("high"), F.col("least").alias("low")).distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        least = wide.groupBy("high").agg(F.min("low").alias("least"))
        narrow = wide.join(least, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        edges = written(narrow.unionAll(least.select("high", F.col("least").alias("low"))).distinct())
        made += 1
        if rounds:
            if made == rounds:
                break
            continue
        previous, state = state, _state(edges)
        if state == previous:
            break
    below = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root"))
    tops = edges.select("low").distinct().join(below, F.col("low") == F.col("node"), "left_anti")
    return below.unionAll(tops.select("low", "low"))
