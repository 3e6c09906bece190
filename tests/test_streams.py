"""The sliding rate limit as table and stream against brute force, and counters under replays."""

import random
from collections import defaultdict

import pytest

from tallybook.operators.freshness import within_window
from tallybook.streaming import counters
from tallybook.streaming.rate_limit import keyed_state, rate_limited
from tallybook.streaming.signals import append_and_close, file_stream

EVENTS = "id bigint, user bigint, ts timestamp"


def brute_window(rows, seconds):
    by = defaultdict(list)
    for _, user, at in rows:
        by[user].append(at)
    return {key: sum(at - seconds < a <= at for a in by[user]) for key, user, at in rows}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(k, rng.choice([1, 2, 2, 2, 2, 3, None]), 1_700_000_000 + rng.randrange(400)) for k in range(500)]
    return out + [(900 + k, 2, 1_700_000_100) for k in range(50)] + [(990, 7, 1_700_000_000 - 10**6), (991, 7, 1_700_000_000 + 10**6)]


def table_of(spark, rows):
    return spark.createDataFrame(rows, "id bigint, user bigint, at bigint").selectExpr("id", "user", "timestamp_seconds(at) AS ts")


@pytest.mark.parametrize("seconds", [1, 7, 60, 3600])
def test_window_of_a_table(spark, rows, seconds):
    got = within_window(table_of(spark, rows), "user", "ts", seconds, 5).collect()
    assert {r.id: r.in_window for r in got} == brute_window(rows, seconds) and all(r.allowed == (r.in_window <= 5) for r in got)


def test_window_without_a_moment(spark):
    got = within_window(spark.createDataFrame([(1, 1, None)], EVENTS), "user", "ts", 60, 5).collect()
    assert [(r.in_window, r.allowed) for r in got] == [(None, None)]


def test_window_of_a_stream(spark, rows, tmp_path):
    rng = random.Random(3)
    near = [r for r in rows if r[0] < 990]
    rng.shuffle(near)  # within the watermark's delay, so no order is asked for
    for k in range(5):
        table_of(spark, near[k::5]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = file_stream(spark, f"{tmp_path}/in", table_of(spark, near).schema, files_per_batch=1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with keyed_state(spark):
        append_and_close(stream, lambda e: rate_limited(e, "user", "ts", 60, 5), "ts", f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/markers")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.id: r.in_window for r in got} == brute_window(near, 60) and len(got) == len(near)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_replayed_batches_change_nothing(spark, tmp_path):
    path, kinds = f"{tmp_path}/counters", spark.createDataFrame([], "fact string").schema
    batch = lambda *rows: spark.createDataFrame(rows, "fact string, voter string")
    got = lambda: {r.fact: r.n for r in counters.counts(spark, path, kinds).collect()}
    assert got() == {}
    first, second = batch(("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("a", None), ("a", None)), batch(("a", "x"), ("a", "z"), ("c", "x"))
    for _ in range(2):
        counters.increment(first, 0, path, "site", ["fact"], "voter")
        assert got() == {"a": 4, "b": 1, None: 1}
    for _ in range(2):
        counters.increment(second, 1, path, "site", ["fact"], "voter")
        counters.increment(first, 0, path, "site", ["fact"], "voter")
        assert got() == {"a": 5, "b": 1, "c": 1, None: 1}
        counters.fold(spark, path, kinds)
    counters.increment(first, 0, path, "app", ["fact"], "voter")  # another feed: only rows without a voter are new
    assert got() == {"a": 7, "b": 1, "c": 1, None: 1}
    counters.increment(batch(("b", "x")), 5, path, "plain", ["fact"])
    assert got() == {"a": 7, "b": 2, "c": 1, None: 1}


def test_counts_are_added_to_a_column(spark):
    base = spark.createDataFrame([("a", 3), ("b", None), ("d", 1)], "fact string, votes bigint")
    counted = spark.createDataFrame([("a", 2), ("b", 1), ("c", 9)], "fact string, n bigint")
    assert {r.fact: r.votes for r in counters.added_to(base, counted, ["fact"], "votes").collect()} == {"a": 5, "b": 1, "d": 1}
