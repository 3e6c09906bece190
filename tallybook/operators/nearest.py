"""The nearest of many centres by branch and bound over a partition of the plane.

A sample of the centres cuts the plane into leaves of about LEAF centres (halves along the wider side, again and again); each leaf
is then known by the box around its centres. A point asks the leaf it would reach by always taking the nearer box, which
bounds its distance, and then only the leaves whose box is no farther than that bound. Wherever a point lies, it meets a few
leaves; no round brings all points and all centres together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallybook.session import written

LEAF = 16
#: Leaves at most; with more than LEAVES * LEAF centres the leaves grow.
LEAVES = 1 << 16
SAMPLE = 200_000


def squared_distance(lon: Column, lat: Column, lon2: Column, lat2: Column) -> Column:
    return (lon - lon2) * (lon - lon2) + (lat - lat2) * (lat - lat2)


class Cuts:
    """A complete binary tree of cuts: node k has the children 2k + 1 and 2k + 2; the last level's nodes are the leaves."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth, inner = depth, (1 << depth) - 1
        self.axis, self.at = np.zeros(inner, np.int64), np.zeros(inner)
        held = [sample]
        for node in range(inner):
            part = held[node]
            axis = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            at = float(np.median(part[:, axis])) if len(part) else 0.0
            self.axis[node], self.at[node] = axis, at
            right = part[:, axis] >= at
            held += [part[~right], part[right]]

    def leaf_of(self, xy: np.ndarray) -> np.ndarray:
        node = np.zeros(len(xy), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (xy[np.arange(len(xy)), self.axis[node]] >= self.at[node])
        return node - (1 << self.depth) + 1


class Boxes:
    """Boxes around the leaves' centres and, of each inner node, around its children; empty ones are infinitely far."""

    def __init__(self, depth: int, leaves: list[tuple[int, float, float, float, float]]) -> None:
        self.depth, first = depth, (1 << depth) - 1
        self.low, self.high = np.full((2 * first + 1, 2), np.inf), np.full((2 * first + 1, 2), -np.inf)
        for leaf, x0, x1, y0, y1 in leaves:
            self.low[first + leaf], self.high[first + leaf] = (x0, y0), (x1, y1)
        for node in range(first - 1, -1, -1):
            self.low[node] = np.minimum(self.low[2 * node + 1], self.low[2 * node + 2])
            self.high[node] = np.maximum(self.high[2 * node + 1], self.high[2 * node + 2])

    def distance(self, node: np.ndarray | int, xy: np.ndarray) -> np.ndarray:
        """Squared distance to a box: never above that to a centre in it, also as rounded."""
        apart = np.maximum(np.maximum(self.low[node] - xy, xy - self.high[node]), 0.0)
        return apart[:, 0] * apart[:, 0] + apart[:, 1] * apart[:, 1]

    def nearer(self, xy: np.ndarray) -> np.ndarray:
        """The leaf reached by taking the child with the nearer box."""
        node = np.zeros(len(xy), np.int64)
        for _ in range(self.depth):
            left = 2 * node + 1
            node = left + (self.distance(left + 1, xy) < self.distance(left, xy))
        return node - (1 << self.depth) + 1

    def within(self, xy: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves whose box is no farther than the row's bound."""
        rows, leaves, first = [], [], (1 << self.depth) - 1
        stack = [(0, np.arange(len(xy)))]
        while stack:
            node, own = stack.pop()
            own = own[self.distance(node, xy[own]) <= bound[own]]
            if not len(own):
                continue
            if node >= first:
                rows.append(own)
                leaves.append(np.full(len(own), node - first))
            else:
                stack += [(2 * node + 1, own), (2 * node + 2, own)]
        none = np.zeros(0, np.int64)
        return np.concatenate(rows or [none]), np.concatenate(leaves or [none])


def _places(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column("lon").to_numpy(zero_copy_only=False), batch.column("lat").to_numpy(zero_copy_only=False)]).astype(float)


def _with_leaf(df: DataFrame, leaf_of) -> DataFrame:
    """df with `leaf`, from (lon, lat) of an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("leaf", pa.array(leaf_of(_places(batch)), pa.int32()))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("leaf", IntegerType())]))


def nearest(points: DataFrame, middles: DataFrame, key: str, area: str, max_distance: float | None = None) -> DataFrame:
    """key, area: the area with the nearest middle (struct lon, lat), the first area of equally near ones, if within max_distance.

    Points and middles without a place have no row; no middles give no rows.
    """
    flat = middles.select(area, F.col("mid.lon").alias("lon"), F.col("mid.lat").alias("lat")).where("lon IS NOT NULL AND lat IS NOT NULL")
    flat = written(flat.groupBy("lon", "lat").agg(F.min(area).alias(area)))  # of centres in one place the first is the nearest
    total = flat.count()
    if not total:
        return points.where("false").select(key, F.lit(None).cast(flat.schema[area].dataType).alias(area))
    sample = flat.select("lon", "lat") if total <= SAMPLE else flat.select("lon", "lat").orderBy(F.xxhash64("lon", "lat")).limit(SAMPLE)
    depth = max(0, math.ceil(math.log2(min(LEAVES, total / LEAF)))) if total > LEAF else 0
    cuts = Cuts(np.array([tuple(r) for r in sample.collect()], float).reshape(-1, 2), depth)
    leaves = written(_with_leaf(flat, cuts.leaf_of).groupBy("leaf").agg(
        F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.collect_list(F.struct("lon", "lat", area)).alias("held")
    ))
    boxes = Boxes(depth, [tuple(r) for r in leaves.select("leaf", "x0", "x1", "y0", "y1").collect()])  # at most LEAVES rows
    held = leaves.select("leaf", "held")
    apart = lambda c: F.struct(squared_distance(F.col("lon"), F.col("lat"), c["lon"], c["lat"]).alias("apart"), c[area].alias("area"))
    best = F.array_min(F.transform("held", apart)).alias("best")
    homes = _with_leaf(points.select(key, "lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL"), boxes.nearer)
    near = written(homes.join(held, "leaf").select(key, "lon", "lat", "leaf", best).withColumn("bound", F.col("best.apart")))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = boxes.within(_places(batch), batch.column("bound").to_numpy())
            other = found != batch.column("leaf").to_numpy()[rows]
            rows = pa.array(rows[other])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in (key, "lon", "lat")), pa.array(found[other], pa.int32())], [key, "lon", "lat", "leaf"])

    asked = near.select(key, "lon", "lat", "leaf", "bound").mapInArrow(others, homes.schema)
    told = near.select(key, "best").unionAll(asked.join(held, "leaf").select(key, best))
    first = told.groupBy(key).agg(F.min("best").alias("best"))
    return (first.where(F.col("best.apart") <= max_distance**2) if max_distance else first).select(key, F.col("best.area").alias(area))
