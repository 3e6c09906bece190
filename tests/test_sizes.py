"""Steps whose memory or time once grew faster than their input."""

import itertools
import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StructField, StructType

from tallybook.operators import entity, gazetteer
from tallybook.sources import markup, paged
from tallybook.streaming import rate_limit


def test_pairs_of_frequent_tokens_meet_once(spark):
    rng = random.Random(5)
    words = [[f"{c}{k:02d}" for k in range(n)] for c, n in (("a", 2), ("b", 3), ("c", 4), ("d", 9))]
    sets = [dict.fromkeys(rng.choice(w) for w in words[rng.randrange(2) :]) for _ in range(300)]
    names = {" ".join(s) for s in sets}
    table = spark.createDataFrame([(n, t) for n in names for t in n.split()], "key string, token string")
    listed = table.withColumnRenamed("key", "listed_key")
    counts = table.groupBy("token").count().withColumnRenamed("count", "held")
    pairs = entity._token_pairs(entity._prefixes(table, "key", counts, 0.6), entity._prefixes(listed, "listed_key", counts, 0.6), 0.6)
    want = {(a, b) for a, b in itertools.product(names, names) if len({*a.split()} & {*b.split()}) >= 0.6 * len({*a.split()} | {*b.split()})}
    got = [(r.key, r.listed_key) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want


class MovingPages:
    """Seven rows a page, newest first; every answer but the first comes when two more rows have come or one has gone."""

    def __init__(self, rows, step):
        self.rows, self.step, self.asked = rows, step, 0

    def fetch(self, stream, page):
        more = [{"id": f"new{k}", "publishedDate": "soon"} for k in range(max(0, self.step))] if self.asked else []
        rows = more + (self.rows[-self.step :] if self.asked and self.step < 0 else self.rows)
        self.asked += 1
        return rows[page * 7 : page * 7 + 7], len(rows)


@pytest.mark.parametrize("step", [0, 2, 30, -1])
def test_ranges_of_pages_have_every_row_once(monkeypatch, step):
    monkeypatch.setattr(paged, "RANGE", 3)
    rows = [{"id": str(n), "publishedDate": "01-02-2024"} for n in range(200)]
    source = paged.Pages({"client": paged.cloudpickle.dumps(None).hex(), "streams": "[]"})
    source.client = MovingPages(rows, step)
    parts = source.stretches("a", None)
    assert len(parts) == 10
    got = [json.loads(v)["id"] for part in reversed(parts) for batch in source.rows(part) for v in batch.column(4).to_pylist()]
    assert sorted(x for x in got if "new" not in x) == sorted(r["id"] for r in rows[max(0, -step) :]) and len(set(got)) == len(got)


def test_feeds_are_parsed_once(spark):
    feeds = spark.createDataFrame([(1, "<rss><channel><item><title>A title of a feed</title></item></channel></rss>"), (2, "<rss><item><title>A title of a cut one</title></item>")], "id int, xml string")
    entries = markup.feed_entries(feeds, "xml")
    assert "from_xml" not in entries._jdf.queryExecution().optimizedPlan().toString().lower().replace("xmltostructs", "from_xml")
    assert sorted((r.id, r.title, r.whole) for r in entries.collect()) == [(1, "A title of a feed", True), (2, "A title of a cut one", False)]


def test_a_batch_of_texts_is_looked_through_in_slices():
    class Texts:
        schema = {"id": StructField("id", LongType())}

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array([f"x{n} ab" for n in range(1000)])], ["id", "_text"])
    found = list(gazetteer._by_automaton(Texts(), ["ab", "x77 "], "id")(iter([batch])))
    assert max(b.num_rows for b in found) <= gazetteer.SLICE + 1
    assert sorted(zip(*(c for c in pa.Table.from_batches(found).to_pydict().values()))) == sorted([(n, "ab") for n in range(1000)] + [(77, "x77 ")])


class Held:
    """State and timers of one key, as a processor sees them."""

    def __init__(self, rows):
        self.rows, self.counts = rows, {}

    def __getattr__(self, name):
        return lambda *given: {"exists": True, "get": self.rows, "iterator": iter(()), "listTimers": [], "getCurrentWatermarkInMs": 10**15}.get(name)


def test_a_key_of_many_seconds_is_judged_in_one_pass():
    limit = rate_limit.SlidingLimit(60, 5, StructType().add("id", LongType()).add("_second", LongType()))
    rows = [(n, n // 2 * 3) for n in range(40_000)]
    limit.handle = Held(rows)
    limit.waiting, limit.counts = Held(rows), Held(rows)
    limit.counts.iterator = lambda: iter([((s,), (1,)) for s in range(-1000, 0)])
    limit.counts.exists = lambda: True
    began = time.perf_counter()
    told = list(limit.handleExpiredTimer(1, Held(rows), Held(rows)))
    assert time.perf_counter() - began < 3  # a sum over all seconds for each of 20,000 takes many times that
    past = [*range(-1000, 0), *(s for _, s in rows[:200])]
    assert [r[1] for r in told] == [sum(s - 60 < p <= s for p in past) for _, s in rows[:200]] + [40] * 39_800
