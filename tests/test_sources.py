"""Readers on small files with the irregularities that portals have."""

import json

from pyspark.sql import functions as F

from tallybook.operators.dedup import keep_first, keep_last, keep_max
from tallybook.operators.entity import flags, fuzzy_matches
from tallybook.operators.merge import partial_upsert, replace_partition, write_guarded
from tallybook.sources import markup, records


def test_work_orders(spark, tmp_path):
    (tmp_path / "ward_12_orders.csv").write_text(
        'wo num,wodetails,contractor,amount,nett,deduction,Ward\n012-24-000001,"Drain, north",123456 M/s Alpha Works0000000001,1000,900,0,\n,,,,,,\n013-24-000002,Road,Beta,"1,234",abc,5,13\n'
    )
    rows = {r["work_order_id"]: r for r in records.work_orders(records.read_csv(spark, str(tmp_path))).collect()}
    assert set(rows) == {"012-24-000001", "013-24-000002"}
    first, second = rows["012-24-000001"], rows["013-24-000002"]
    assert (first["ward_no"], first["description"], first["contractor_name"], float(first["deduction"]), first["fy"]) == (12, "Drain, north", "Alpha Works", 100.0, "2023-24")
    assert (float(second["sanctioned_amount"]), float(second["net_paid"]), float(second["deduction"])) == (1.0, 0.0, 5.0)


def test_positional_files(spark, tmp_path):
    row = lambda kind, date, trade, fee, ward: ",".join([kind, date, "", "", "", trade, "", "", "", "", fee, "", ward])
    (tmp_path / "licences.csv").write_text("\n".join([row("New", "1 2024", "Tea", '"Rs 1,200.50"', "W1"), row("Renewal", "1 2014", "Tea", "1", "W1"), row("Renewal", "2025", "\\N", "x", "W2")]))
    names = [f"_c{k}" for k in range(13)]
    got = records.licences(records.read_csv(spark, str(tmp_path), header=False, schema=records.strings(*names))).orderBy("ward_name").collect()
    assert [(r["year"], r["is_new"], r["trade"], r["fee"]) for r in got] == [(2024, True, "Tea", 1200.5), (2025, False, None, 0.0)]


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    features = [{"properties": {"ward": "1"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {"ward": "2"}, "geometry": {"type": "MultiPolygon", "coordinates": [square]}}, {"properties": {"ward": "3"}, "geometry": None}]
    (tmp_path / "w.json").write_text(json.dumps({"features": features}))
    got = records.features(spark, str(tmp_path), "ward").collect()
    assert sorted(r["id"] for r in got) == ["1", "2"] and got[0]["ring"][1]["lon"] == 2.0


def test_feeds_and_tables(spark):
    rss = "<rss><item><title><![CDATA[Lake <b>dries</b> &amp; cracks]]></title><link>http://x</link><pubDate>Tue, 03 Jun 2025 10:00:00 GMT</pubDate></item><item><title>short</title></item></rss>"
    atom = '<feed><entry><title>A long enough title</title><link rel="x" href="http://y"/><published>2025-06-03T10:00:00Z</published></entry></feed>'
    got = markup.feed_items(spark.createDataFrame([(rss,), (atom,)], "xml string"), F.col("xml")).orderBy("title").collect()
    assert [(r["title"], r["link"], str(r["published"])) for r in got] == [("A long enough title", "http://y", "2025-06-03 10:00:00"), ("Lake dries & cracks", "http://x", "2025-06-03 10:00:00")]
    page = "<table><tr><th>h</th></tr><tr><td>1</td><td>Dept</td><td>3</td><td>4</td><td> 5 </td></tr><tr><td>x</td><td>y</td><td>3</td><td>4</td><td>5</td></tr></table>"
    rows = markup.table_rows(spark.createDataFrame([(page,)], "html string"), F.col("html")).collect()
    assert [r["cells"] for r in rows] == [["1", "Dept", "3", "4", "5"]]


def test_dedup_ties(spark):
    df = spark.createDataFrame([(1, 1, 5, "a"), (1, 2, 5, "b"), (1, 3, None, "c"), (2, 1, 1, "d")], "k int, o int, m int, v string")
    value = lambda d: {r["k"]: r["v"] for r in d.collect()}
    assert value(keep_first(df, ["k"], ["o"])) == {1: "a", 2: "d"}
    assert value(keep_last(df, ["k"], ["o"])) == {1: "c", 2: "d"}
    assert value(keep_max(df, ["k"], "m", ["o"])) == {1: "a", 2: "d"}


def test_fuzzy_matches_brute_force(spark):
    from tallybook.functions.text import entity_key, name_distance

    words = ["alpha", "beta", "gamma", "delta", "road", "works", "ab", "x"]
    names = [(f"e{i}{j}{k}", f"{words[i]} {words[j]} {words[k]}") for i in range(8) for j in range(8) for k in range(0, 8, 3)] + [("e", "Alphabet"), ("n", None), ("s", "x")]
    listed = [("Alpha Beta Pvt Ltd", "s1"), ("works", "s2"), ("gamma delta road", "s1"), ("ab", "s3"), ("pha", "s4")]
    left, right = spark.createDataFrame(names, "entity_id string, name string"), spark.createDataFrame(listed, "listed_name string, source string")
    got = {(r["entity_id"], r["listed_name"]): r["distance"] for r in fuzzy_matches(left, right).collect()}
    keyed = left.withColumn("a", entity_key(F.col("name"))).join(right.withColumn("b", entity_key(F.col("listed_name")))).withColumn("d", name_distance(F.col("a"), F.col("b")))
    assert got == {(r["entity_id"], r["listed_name"]): r["d"] for r in keyed.where("d <= 0.4").collect()}
    assert flags(fuzzy_matches(left, right)).where("entity_id = 'e'").first()["blacklist_flags"] == ["s3", "s4"]  # the key holds AB too


def test_merges(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", None), (2, "b", "live")], "k int, v string, src string")
    new = spark.createDataFrame([(2, "B", "live"), (3, "C", "live")], "k int, v string, src string")
    assert {r["k"] for r in replace_partition(base, new, "src", "live").collect()} == {1, 2, 3}
    updated = {r["k"]: (r["v"], r["src"]) for r in partial_upsert(base, new.withColumn("src", F.lit("x")), ["k"], ["v"]).collect()}
    assert updated == {1: ("a", None), 2: ("B", "live"), 3: ("C", "x")}
    path = str(tmp_path / "t")
    assert write_guarded(base, path) and not write_guarded(base.where("false"), path)
    assert spark.read.parquet(path).count() == 2


def test_landed_or(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert records.landed_or(spark, str(tmp_path / "cache"), fetch).count() == 3
    assert calls == [1]


def test_ranked_without_a_bound(spark):
    from tallybook.operators.ranking import ranked

    df = spark.range(1000, numPartitions=7).selectExpr("CASE WHEN id % 3 > 0 THEN id % 3 END AS g", "(id * 37) % 101 AS v", "id")
    for group in ([], ["g"]):
        got = {}
        for r in ranked(df, group, [F.desc("v"), F.asc("id")]).collect():
            got.setdefault(r["g"] if group else 0, []).append((r["rank"], -r["v"], r["id"]))
        for rows in got.values():
            assert [x[0] for x in sorted(rows)] == list(range(1, len(rows) + 1))
            assert [x[1:] for x in sorted(rows)] == sorted(x[1:] for x in rows)


def test_repeated_rows_are_updated_each(spark):
    from tallybook.operators.joins import update_by_prefix_else_word

    df = spark.createDataFrame([("Alpha Road", None), ("Alpha Road", None), ("West End", "1"), (None, "2"), ("X", None)], "name string, phone string")
    updates = spark.createDataFrame([("alpha", "9"), ("The End", "8"), ("x", "7"), (None, "6")], "name string, phone string")
    got = sorted(map(tuple, update_by_prefix_else_word(df, updates, "name", ["phone"]).collect()), key=str)
    assert got == sorted([("Alpha Road", "9"), ("Alpha Road", "9"), ("West End", "8"), (None, "2"), ("X", "7")], key=str)


def test_nearest_far_and_missing_points(spark):
    from tallybook.operators.spatial import locate_or_nearest

    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    areas = spark.createDataFrame([(k, [(x + 10.0 * k, y) for x, y in ring]) for k in range(4)], "area int, ring array<struct<lon: double, lat: double>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 300.0, 80.0), (3, None, 1.0), (4, 11.2, 0.5), (5, 15.6, -40.0)], "id int, lon double, lat double")
    got = {r["id"]: (r["area"], r["how"]) for r in locate_or_nearest(points, areas, "id", "area").collect()}
    assert got == {1: (0, "contains"), 2: (3, "nearest"), 3: (None, "none"), 4: (1, "nearest"), 5: (2, "nearest")}
    near = {r["id"]: (r["area"], r["how"]) for r in locate_or_nearest(points, areas, "id", "area", max_distance=5.0).collect()}
    assert near == {1: (0, "contains"), 2: (None, "none"), 3: (None, "none"), 4: (1, "nearest"), 5: (None, "none")}
