"""Points and polygons: containment by a join on cells of each polygon's own size, nearest by bounds.

Polygons have a column ring, an array of struct(lon, lat); the first ring of a multipolygon counts. Points on an edge
follow the half-open rule of ray casting, so a point belongs to one of two neighbours at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.operators.nearest import nearest
from tallybook.session import written

#: Cells along the longer side of a polygon, at most twice as many.
CELLS = 16


def contains(ring: Column, lon: Column, lat: Column) -> Column:
    """Ray casting as a fold over the ring's edges."""
    n = F.size(ring)

    def crossing(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return F.when(spans & (lon < at), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crossing), F.lit(0), lambda s, x: s + x) % 2 == 1


def cells_of(ring: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The level of a ring's cells (of side 2**level) and the x, y of those it touches or holds, with whether it holds them whole.

    A cell that an edge comes near counts as touched, so a whole one lies inside whatever the rounding.
    """
    low, high = ring.min(axis=0), ring.max(axis=0)
    extent = float(max(high - low))
    level = math.ceil(math.log2(extent / (2 * CELLS))) if extent > 0 else -40
    level = max(level, math.ceil(math.log2(max(abs(low).max(), abs(high).max(), 1e-9))) - 40)  # cells stay well above the coordinates' precision
    side = 2.0**level
    first, last = np.floor(low / side).astype(np.int64), np.floor(high / side).astype(np.int64)
    wide, tall = (last - first + 1).tolist()
    touched = np.zeros((tall, wide), bool)
    scaled, slack = ring / side - first, 1e-6
    for (ax, ay), (bx, by) in zip(scaled.tolist(), np.roll(scaled, -1, axis=0).tolist()):
        rows = np.arange(max(0, math.floor(min(ay, by) - slack)), min(tall - 1, math.floor(max(ay, by) + slack)) + 1)
        if ay == by:
            starts, ends = np.full(len(rows), min(ax, bx)), np.full(len(rows), max(ax, bx))
        else:
            cut = lambda y: ax + (np.clip(y, min(ay, by), max(ay, by)) - ay) * (bx - ax) / (by - ay)  # noqa: B023, E731
            enters, leaves = cut(rows - slack), cut(rows + 1 + slack)
            starts, ends = np.minimum(enters, leaves), np.maximum(enters, leaves)
        for row, a, b in zip(rows.tolist(), np.floor(starts - slack).astype(int).tolist(), np.floor(ends + slack).astype(int).tolist()):
            touched[row, max(0, a) : b + 1] = True
    y, x = np.indices((tall, wide)).reshape(2, -1)
    a, b = scaled, np.roll(scaled, -1, axis=0)
    inside = np.zeros(len(x), bool)
    for (ax, ay), (bx, by) in zip(a.tolist(), b.tolist()):
        if ay != by:
            inside ^= ((ay > y + 0.5) != (by > y + 0.5)) & (x + 0.5 < ax + (y + 0.5 - ay) * (bx - ax) / (by - ay))
    touched = touched.ravel()
    kept = touched | inside
    return level, x[kept] + first[0], y[kept] + first[1], ~touched[kept]


def covered(polygons: DataFrame) -> DataFrame:
    """polygon, level, cell_x, cell_y, whole: a bounded number of cells for each polygon (polygon, ring), large or small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for polygon, ring in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                corners = [(p["lon"], p["lat"]) for p in ring or () if p and p["lon"] is not None and p["lat"] is not None]
                if len(corners) < 3:
                    continue
                level, x, y, whole = cells_of(np.array(corners, float))
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array([polygon] * n, pa.int64()), pa.array([level] * n, pa.int32()), pa.array(x), pa.array(y), pa.array(whole)], ["polygon", "level", "cell_x", "cell_y", "whole"])

    return polygons.select("polygon", "ring").mapInArrow(run, "polygon bigint, level int, cell_x bigint, cell_y bigint, whole boolean")


def locate(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Each point with the polygons that contain it (their columns but the ring).

    A polygon is covered by cells of its own size: a country has no more of them than a ward. Points look themselves up in an
    equi-join, once for each cell size there is. Cells that lie in a polygon whole decide at once; ray casting runs for the points
    of its edge cells only.
    """
    named = written(polygons.withColumn("polygon", F.monotonically_increasing_id()))
    cover = written(covered(named))
    levels = [r[0] for r in cover.select("level").distinct().collect()]  # a few, however many polygons
    if not levels:
        return points.join(polygons.drop("ring").where("false"))
    cell = lambda c, level: F.floor(F.col(c) / F.lit(2.0**level)).alias(f"cell_{'x' if c == 'lon' else 'y'}")
    at = F.explode(F.array(*(F.struct(F.lit(level).alias("level"), cell("lon", level), cell("lat", level)) for level in sorted(levels))))
    looked = points.where("lon IS NOT NULL AND lat IS NOT NULL").select("*", at.alias("_at")).select(*points.columns, "_at.*")
    met = looked.join(cover, ["level", "cell_x", "cell_y"]).drop("level", "cell_x", "cell_y")
    whole = met.where("whole").join(named.drop("ring"), "polygon")
    edge = met.where("NOT whole").join(named, "polygon").where(contains(F.col("ring"), F.col("lon"), F.col("lat"))).drop("ring")
    return whole.unionByName(edge).drop("polygon", "whole")


def counts_by_area(points: DataFrame, polygons: DataFrame, area: str, *by: str) -> DataFrame:
    return locate(points, polygons).groupBy(area, *by).agg(F.count("*").alias("points"))


def centroid(ring: Column) -> Column:
    """Unweighted mean of the vertices."""
    total = F.aggregate(ring, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, p: F.struct((s["x"] + p["lon"]).alias("x"), (s["y"] + p["lat"]).alias("y")))
    return F.struct((total["x"] / F.size(ring)).alias("lon"), (total["y"] / F.size(ring)).alias("lat"))


def locate_or_nearest(points: DataFrame, polygons: DataFrame, key: str, area: str, max_distance: float | None = None) -> DataFrame:
    """The containing area, else the one with the nearest centroid (within max_distance, if given).

    `how` tells which: contains, nearest, or none (with a null area) for points without a place or too far from all.
    """
    inside = written(locate(points.select(key, "lon", "lat"), polygons.select(area, "ring")).groupBy(key).agg(F.min(area).alias(area)))
    outside = written(points.select(key, "lon", "lat").join(inside, key, "left_anti"))
    near = written(nearest(outside, polygons.select(F.col(area), centroid(F.col("ring")).alias("mid")), key, area, max_distance))
    rest = outside.join(near, key, "left_anti").select(key, F.lit(None).cast(inside.schema[area].dataType).alias(area), F.lit("none").alias("how"))
    return inside.withColumn("how", F.lit("contains")).unionByName(near.withColumn("how", F.lit("nearest"))).unionByName(rest)


def pin_lookup(points: DataFrame, key: str, **schemes: tuple[DataFrame, str]) -> DataFrame:
    """key, found, and per scheme (its polygons and their number) that scheme's number and attributes, prefixed by its name.

    `found` is true if the first scheme has an area around the point. Of overlapping areas of a scheme the lowest number counts.
    """
    told = points.select(key).distinct()
    for name, (polygons, number) in schemes.items():
        others = [c for c in polygons.columns if c not in ("ring", number)]
        hit = locate(points.select(key, "lon", "lat"), polygons).groupBy(key).agg(F.min(F.struct(number, *others)).alias("_hit"))
        told = told.join(hit.select(key, *(F.col(f"_hit.{c}").alias(f"{name}_{c}") for c in (number, *others))), key, "left")
    first, (_, number) = next(iter(schemes.items()))
    return told.withColumn("found", F.col(f"{first}_{number}").isNotNull())


def jurisdictions(points: DataFrame, boundaries: DataFrame, key: str) -> DataFrame:
    """All boundaries around a point by type: map of type to sorted names."""
    named = locate(points, boundaries).groupBy(key, "type").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return named.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "names")))).alias("jurisdictions"))
