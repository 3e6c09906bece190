"""Areas of every size and the nearest of many centres against brute force."""

import math
import random

import numpy as np
import pytest

from tallybook.operators import nearest as nearest_module
from tallybook.operators.nearest import Boxes, Cuts, nearest
from tallybook.operators.spatial import cells_of, covered, locate, pin_lookup

RING = "ring array<struct<lon: double, lat: double>>"


def inside(ring, x, y):
    held = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            held = not held
    return held


def star(rng, x, y, radius, corners):
    turns = sorted(rng.random() * 2 * math.pi for _ in range(corners))
    return [(x + radius * r * math.cos(t), y + radius * r * math.sin(t)) for t, r in ((t, rng.uniform(0.3, 1)) for t in turns)]


@pytest.fixture(scope="module")
def areas():
    rng = random.Random(8)
    out = [(k, star(rng, rng.uniform(-5, 5), rng.uniform(-5, 5), 10 ** rng.uniform(-3, 3), rng.choice([3, 5, 40]))) for k in range(60)]
    out += [(100, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]), (101, [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)]), (102, None), (103, []), (104, [(0.0, 0.0), (1.0, 1.0)])]
    return out + [(105, [(0.0, 0.0), (1e-9, 0.0), (1e-9, 5.0), (0.0, 5.0)]), (106, [(3.0, 3.0)] * 4)]


def test_areas_of_all_sizes(spark, areas):
    rng = random.Random(9)
    points = [(k, rng.gauss(0, 10 ** rng.uniform(-2, 2)), rng.gauss(0, 10 ** rng.uniform(-2, 2))) for k in range(400)]
    points += [(500 + k, x, y) for k, (x, y) in enumerate(p for _, ring in areas[:20] for p in ring[:2])] + [(900, 0.5, 0.5), (901, 1.0, 0.5), (902, None, 1.0), (903, 5e-10, 1.0)]
    want = {(k, a) for k, x, y in points if x is not None for a, ring in areas if ring and len(ring) > 2 and inside(ring, x, y)}
    table = spark.createDataFrame([(a, r) for a, r in areas], f"area int, {RING}")
    got = [(r.id, r.area) for r in locate(spark.createDataFrame(points, "id int, lon double, lat double"), table).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_country_has_no_more_cells_than_a_ward(spark, areas):
    table = spark.createDataFrame([(k, [(x * s, y * s) for x, y in ((0, 0), (1, 0.2), (1, 1), (0, 0.7))]) for k, s in enumerate((1e-6, 0.01, 1.0, 1e5))], f"polygon bigint, {RING}")
    cells = covered(table).groupBy("polygon").count().collect()
    assert len(cells) == 4 and all(100 < r["count"] < 1200 for r in cells)
    assert covered(table).where("whole").count() > 100 * 4


def test_whole_cells_lie_inside(areas):
    rng = random.Random(1)
    for _, ring in areas[:60]:
        level, xs, ys, whole = cells_of(np.array(ring))
        for x, y in zip(xs[whole].tolist(), ys[whole].tolist()):
            assert inside(ring, (x + rng.random()) * 2.0**level, (y + rng.random()) * 2.0**level)


def test_nothing_to_be_in(spark):
    points, none = spark.createDataFrame([(1, 0.0, 0.0)], "id int, lon double, lat double"), spark.createDataFrame([], f"area int, {RING}")
    assert locate(points, none).count() == 0
    assert [tuple(r) for r in pin_lookup(points, "id", old=(none, "area"), new=(none, "area")).collect()] == [(1, None, None, False)]


def test_both_schemes(spark):
    box = lambda x: [(x, 0.0), (x + 2.0, 0.0), (x + 2.0, 2.0), (x, 2.0)]
    old = spark.createDataFrame([(1, "A", box(0.0)), (2, "B", box(1.0))], f"no int, name string, {RING}")
    new = spark.createDataFrame([(9, box(2.5))], f"no int, {RING}")
    points = spark.createDataFrame([(1, 1.5, 1.0), (2, 2.75, 1.0), (3, 4.0, 1.0), (4, None, None)], "id int, lon double, lat double")
    got = {r.id: (r.found, r.old_no, r.old_name, r.new_no) for r in pin_lookup(points, "id", old=(old, "no"), new=(new, "no")).collect()}
    assert got == {1: (True, 1, "A", None), 2: (True, 2, "B", 9), 3: (False, None, None, 9), 4: (False, None, None, None)}


@pytest.mark.parametrize("leaf", [1, 4, 1000])
def test_nearest_against_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(nearest_module, "LEAF", leaf)
    rng = random.Random(leaf)
    middles = [(k, rng.choice([0.0, 1.0, rng.random()]), rng.random()) for k in range(150)] + [(150 + k, 0.5, 0.5) for k in range(60)] + [(300, None, 1.0)]
    points = [(k, rng.random(), rng.random()) for k in range(200)] + [(200 + k, rng.choice([-1, 1]) * 1000 * rng.random(), 1000 * rng.random()) for k in range(50)] + [(400, None, 0.0)]
    want = {k: min(((x - a) * (x - a) + (y - b) * (y - b), m) for m, a, b in middles if a is not None)[1] for k, x, y in points if x is not None}
    table = spark.createDataFrame([(m, {"lon": a, "lat": b} if a is not None else None) for m, a, b in middles], "area int, mid struct<lon: double, lat: double>")
    got = nearest(spark.createDataFrame(points, "id int, lon double, lat double"), table, "id", "area").collect()
    assert {r.id: r.area for r in got} == want and len(got) == len(want)


def test_far_points_ask_no_more_leaves():
    rng = np.random.default_rng(4)
    centres = rng.random((4096, 2))
    cuts = Cuts(centres, 8)
    leaf = cuts.leaf_of(centres)
    boxes = Boxes(8, [(k, *(f(centres[leaf == k][:, a]) for a in (0, 1) for f in (np.min, np.max))) for k in np.unique(leaf).tolist()])

    def asked(points):
        home = boxes.nearer(points)
        bound = np.array([((centres[leaf == h] - p) ** 2).sum(axis=1).min() for p, h in zip(points, home)])
        return len(boxes.within(points, bound)[0]) / len(points)

    near, far = rng.random((200, 2)), rng.random((200, 2)) + [1000.0, 300.0]
    assert asked(near) < 6 and asked(far) < 6
