"""Files of several headers and their catalogue, and gazetteers of any size, on small fixtures."""

import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql.types import LongType, StructType

from tallybook.operators import gazetteer
from tallybook.sources import catalogue, grids, markup
from tallybook.sources.paged import PUSHDOWN, load_pages, stream_pages
from tallybook.sources.records import ORDER_FIELDS, read_csv
from tallybook.streaming.signals import append_available


@pytest.fixture
def files(tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    (folder / "Ward 001 [a].csv").write_text("﻿wo num,amount,nett\n001-24-000001,100,90\n,,\n")
    (folder / "b.csv").write_text('Amount Paid , "Contractor Name & Phone",Amount,id\n9,"M/s Alpha, Works0000000001",10,7-24-2\n8,x\n')
    (folder / "c+d.csv").write_text("ID,WARD,AMOUNT\n5,33 North,7\n")
    (folder / "empty.csv").write_text("")
    return folder


def test_each_file_is_read_under_its_own_header(spark, files):
    got = sorted((r.order, r.amount, r.net, r.vendor, r.ward, r.source_file) for r in catalogue.read_layouts(spark, str(files), ORDER_FIELDS).collect() if r.order)
    assert [g[:5] for g in got] == [("001-24-000001", "100", "90", None, None), ("5", "7", None, None, "33 North"), ("7-24-2", "10", "9", "M/s Alpha, Works0000000001", None)]


def test_catalogue_tells_the_ward(spark, files, tmp_path):
    listed = [("Ward 017", "https://x/dl/Ward%20001%20%5Ba%5D.csv?v=2", "CSV"), ("FY 2024", "https://x/b.csv", "text/csv"), ("Ward 9", "https://x/c%2Bd.csv", "pdf"), ("Ward 3", "https://x/gone.csv", "CSV")]
    path = tmp_path / "catalogue.json"
    path.write_text(json.dumps({"result": {"resources": [dict(zip(("name", "url", "format"), r)) for r in listed]}}))
    orders = catalogue.catalogue_work_orders(spark, str(path), str(files)).collect()
    assert sorted((r.work_order_id, r.ward_no, float(r.sanctioned_amount), float(r.net_paid), r.contractor_phone, r.resource_year) for r in orders) == [
        ("001-24-000001", 17, 100.0, 90.0, None, None), ("7-24-2", 7, 10.0, 9.0, "0000000001", 2024),
    ]
    rows = catalogue.read_layouts(spark, str(files), ORDER_FIELDS)
    assert [r.name for r in catalogue.missing_files(catalogue.resources(spark, str(path)), rows).collect()] == ["Ward 3"]


def test_one_header_for_all_is_an_error_where_there_are_two(spark, files):
    with pytest.raises(Exception, match="CSV header"):
        read_csv(spark, [str(files / "b.csv"), str(files / "c+d.csv")]).collect()


def test_unquoted_commas_part_fields(spark, tmp_path):
    (tmp_path / "stations.csv").write_text('name,phone\n"North, East",1\n')
    fields = {"name": ("name",), "phone": ("phone",)}
    assert [(r.name, r.phone) for r in catalogue.read_layouts(spark, str(tmp_path), fields, quotes=False).collect()] == [('"North', 'East"')]
    assert [(r.name, r.phone) for r in catalogue.read_layouts(spark, str(tmp_path), fields).collect()] == [("North, East", "1")]


def test_nothing_landed(spark, tmp_path):
    assert catalogue.read_layouts(spark, str(tmp_path), ORDER_FIELDS).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 0])
@pytest.mark.parametrize("rule", ["declared", "longest"])
def test_gazetteer_of_either_size(spark, monkeypatch, most, rule):
    monkeypatch.setattr(gazetteer, "AUTOMATON_BYTES", most)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc ü") for _ in range(n))
    names = list({word(rng.randint(1, 5)): (rng.randrange(40), k) for k in range(500)}.items())
    texts = [(k, word(rng.randrange(60)).upper()) for k in range(80)] + [(98, None), (99, "")]
    want = {}
    for key, text in texts:
        for alias, (place, ordinal) in names:
            if text and alias in text.lower():
                rank = (ordinal, alias) if rule == "declared" else (-len(alias), ordinal, alias)
                want[key, place] = min(want.get((key, place), (rank, alias)), (rank, alias))
    table = spark.createDataFrame([(a, *r) for a, r in names] + [("", 1, 0)], "alias string, place int, ordinal int")
    hits = gazetteer.place_hits(spark.createDataFrame(texts, "id int, text string"), table, "id", "text", rule=rule)
    assert "NestedLoop" not in hits._jdf.queryExecution().toString() and "Cartesian" not in hits._jdf.queryExecution().toString()
    assert {(r.id, r.place): r.alias for r in hits.collect()} == {k: alias for k, (_, alias) in want.items()}


def test_hints_come_before_titles(spark):
    names = spark.createDataFrame([("north", 1, 0), ("park", 2, 1), ("north park", 3, 2)], "alias string, place int, ordinal int")
    signals = spark.createDataFrame([(1, "near Park", "North Park fair"), (2, None, "north"), (3, None, None)], "id int, hint string, title string")
    hits = gazetteer.place_hits(signals, names, "id", "hint", "title")
    assert {r.id: list(r.places) for r in gazetteer.places_in_order(hits, "id").collect()} == {1: [2, 1, 3], 2: [1]}
    assert {r.id: (r.place, r.alias) for r in gazetteer.first_place(hits, "id").collect()} == {1: (2, "park"), 2: (1, "north")}
    assert {(r.id, r.alias) for r in gazetteer.outermost(hits, "id").collect()} == {(1, "park"), (1, "north park"), (2, "north")}
    empty = gazetteer.place_hits(signals, names.where("false"), "id", "title")
    assert empty.count() == 0


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import a test


class CountedPages:
    """Pages of ten rows a stream, newest first, and a note of each page asked for."""

    def __init__(self, notes, rows):
        self.notes, self.rows = str(notes), rows

    def fetch(self, stream, page):
        with open(f"{self.notes}/{stream}-{page}", "a"):
            pass
        rows = self.rows.get(stream, [])
        return rows[page * 10 : page * 10 + 10], len(rows)


@pytest.fixture
def paged(tmp_path):
    day = lambda n: f"{n % 28 + 1:02d}-{n // 28 + 1:02d}-2024 10:00"
    rows = {s: [{"id": f"{s}{n}", "publishedDate": "soon" if n % 9 == 4 else day(n)} for n in range(119, -1, -1)] for s in ("a", "b")}
    (tmp_path / "notes").mkdir()
    return CountedPages(tmp_path / "notes", rows), tmp_path / "notes", tmp_path


def test_pages_stop_at_the_first_known_row(spark, paged):
    client, notes, _ = paged
    got = load_pages(spark, client, ["a", "none"], since="2024-04-12").collect()  # day 95 of 0 to 119
    assert sorted(p.name for p in notes.iterdir()) == ["a-0", "a-1", "a-2", "none-0"]
    assert sorted(int(json.loads(r.value)["id"][1:]) for r in got) == sorted({*range(96, 120), 94})
    assert load_pages(spark, client, ["a"], since="2024-04-12", full=True).count() == 120 and len(list(notes.iterdir())) == 13


def test_streams_that_no_one_asks_for_are_not_read(spark, paged):
    client, notes, _ = paged
    spark.conf.set(PUSHDOWN, "true")
    try:
        assert load_pages(spark, client, ["a", "b"]).where("stream = 'b' AND page < 2").count() == 20
    finally:
        spark.conf.set(PUSHDOWN, "false")
    assert {p.name[0] for p in notes.iterdir()} == {"b"}
    assert load_pages(spark, client, ["a", "b"]).where("stream = 'a'").count() == 120


def test_a_stream_goes_on_from_its_offset(spark, paged):
    client, notes, folder = paged
    whole, early = client.rows["a"], CountedPages(client.notes, {"a": client.rows["a"][60:]})
    for source in (early, early, client):
        rows = stream_pages(spark, source, ["a"]).where("issued IS NOT NULL").selectExpr("get_json_object(value, '$.id') AS id")
        append_available(rows, f"{folder}/out", f"{folder}/state")
    got = [r.id for r in spark.read.parquet(f"{folder}/out").collect()]
    assert sorted(got) == sorted(r["id"] for r in whole if r["publishedDate"] != "soon")


def test_one_broken_answer_leaves_the_others(spark, tmp_path):
    good = [{"wcname": "017-25-1", "amount": "12.5", "wbid": 7, "jobcode": "Contractor : 123 Alpha&lt;br&gt;"}, {"wcname": " ", "amount": "1"}, {"wcname": "x", "amount": ["odd"], "wbid": "9z"}, None]
    files = {"good": json.dumps(good), "cut": json.dumps(good)[:-7], "page": "<html>", "portal": '{"rError": "none"}', "blank": "", "other": "17", "bom": "﻿[]"}
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(body)
    answered = grids.opened(grids.answers(spark, str(tmp_path)).selectExpr("regexp_extract(source_path, '(\\\\w+).json', 1) AS ward", "value"))
    errors = {r.ward: (r.error or "").split(":")[0] for r in answered.collect()}
    # A file of nothing has no row at all.
    assert errors == {"good": "", "cut": "not JSON", "page": "not JSON", "portal": "portal", "other": "no rows", "bom": ""}
    got = [(r.ward, r.work_order_id, r.sanctioned_amount and float(r.sanctioned_amount), r.bill_no, r.contractor_code, r.odd) for r in grids.payments(answered, "ward").collect()]
    assert got == [("good", "017-25-1", 12.5, 7, "123", ""), ("good", "x", None, None, None, "amount,wbid")]


def test_cells_that_are_none_of_their_type(spark):
    rows = spark.createDataFrame([("1", "x", "k"), ("y", None, "k"), ("2", " ", "k")], "a string, b string, c string")
    got = grids.typed_or_error(rows, StructType().add("a", LongType()).add("b", LongType())).collect()
    assert [(r.c, r.a, r.b, r.errors) for r in got] == [("k", 1, None, ["b"]), ("k", None, None, ["a"]), ("k", 2, None, [])]


RSS = '<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE rss><rss xmlns:m="http://m"><channel><title>T</title>{}</channel></rss>'
ITEM = "<item k='v'><m:title>no</m:title><title>{}</title><description>{}</description><link>{}</link></item>"


def test_feeds_as_xml(spark):
    rss = RSS.format(ITEM.format("Nested <b>and <i>deep</i></b> title", "<![CDATA[<p>A &amp; B</p>]]>", " http://a?x=1&amp;y=2 ") + ITEM.format("short", "", "") + ITEM.format("A second longer title", "", "u") + ITEM.format("Beyond the first three", "", "u") * 3)
    single = RSS.format(ITEM.format("One item alone is a list", "", "u"))
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">Entry &amp;lt;b&amp;gt; title</title><link rel="edit" href="e"/><link rel="alternate" href="h"/><published>2024-01-02T03:04:05Z</published></entry></feed>'
    cut = RSS.format(ITEM.format("Whole item of a cut feed", "A &amp;amp; B", "u") + "<item><title>Cut item that has no end</tit")[:-20]
    feeds = spark.createDataFrame([(1, rss), (2, single), (3, atom), (4, cut), (5, None), (6, "no feed"), (7, "<rss><channel/></rss>")], "id int, xml string")
    got = {(r.id, r.place): (r.title, r.body, r.link, r.whole) for r in markup.feed_entries(feeds, "xml", first=3).collect()}
    assert got == {
        (1, 0): ("Nested and deep title", "A & B", "http://a?x=1&y=2", True), (1, 2): ("A second longer title", None, "u", True), (2, 0): ("One item alone is a list", None, "u", True),
        (3, 0): ("Entry title", None, "h", True), (4, 0): ("Whole item of a cut feed", "A & B", "u", False),
    }
