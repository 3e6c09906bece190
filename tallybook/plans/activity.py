"""Events: windows, freshness, merges, rate limits, votes, points in cells, and the same feeds as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.bands import trust_level
from tallybook.functions.text import relative_time
from tallybook.operators.dedup import union_first
from tallybook.operators.freshness import freshness, trailing, verdict, within_window
from tallybook.operators.joins import not_yet, update_from
from tallybook.operators.merge import expire, insert_ignore, partial_upsert, replace_partition, upsert
from tallybook.operators.rollup import argmax_rows, count_where
from tallybook.operators.nearest import nearest
from tallybook.operators.spatial import centroid, counts_by_area, locate_or_nearest, pin_lookup
from tallybook.session import shared_folder, table
from tallybook.streaming.counters import added_to, counts, fold, increment, increment_available
from tallybook.streaming.rate_limit import keyed_state, rate_limited
from tallybook.streaming.signals import append_and_close, append_available, deduplicated, file_stream, insert_new_available, per_place, sessions, windowed_counts

MOMENT = "2024-01-28 00:00:00"
AS_OF = f"TIMESTAMP_NTZ '{MOMENT}'"


def _as_of():
    return F.expr(AS_OF)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def top_events_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten users with most purchases in the last seven days: a top-k report."""
    recent = trailing(_events(spark, sf_dir).where("event_type = 'purchase' AND user_id IS NOT NULL"), "ts", _as_of(), "7 DAYS")
    return recent.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness({"events": (_events(spark, sf_dir), "ts"), "orders": (table(spark, sf_dir, "orders"), "o_orderdate"), "lineitem": (table(spark, sf_dir, "lineitem"), "l_shipdate"), "missing": (lambda: table(spark, sf_dir, "no_such_table"), "ts")}, _as_of())


def table_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir).withColumn("latest", F.col("latest").cast("string"))


def health_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict(_profile(spark, sf_dir), ["events", "orders"], "lineitem", _as_of())


def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type: all, last day, last week, users, and a value from the JSON column."""
    day, week = (F.col("ts") > _as_of() - F.expr(f"INTERVAL {n} DAYS") for n in (1, 7))
    before = F.col("ts") <= _as_of()
    return _events(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("total"), count_where(day & before).alias("last_24h"), count_where(week & before).alias("last_7d"),
        F.countDistinct("user_id").alias("users"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k_sum"),
    )


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows (before the 20th) and a batch (from the 10th on, values doubled): they overlap."""
    events = _events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    return events.where("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'"), events.where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'").withColumn("value", F.col("value") * 2)


def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert(*_halves(spark, sf_dir), ["event_id"], ["ts"])


def merge_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_ignore(*_halves(spark, sf_dir), ["event_id"], ["ts"])


def merge_replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _halves(spark, sf_dir)
    return replace_partition(base, new.where("event_type = 'error'"), "event_type", "error")


def merge_partial_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _halves(spark, sf_dir)
    return partial_upsert(base, new.withColumn("event_type", F.lit("changed")), ["event_id"], ["value"])


def merge_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _halves(spark, sf_dir)
    return update_from(base, new, ["event_id"], ["value"])


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows first, old ones where no new one has their id."""
    base, new = _halves(spark, sf_dir)
    return union_first(new, base, ["event_id"]).select("event_id", "event_type", "value")


def expire_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events expire after ten days unless they are purchases (kept by an editor)."""
    facts = _events(spark, sf_dir).select("event_id", "event_type", (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"), (F.col("event_type") == "purchase").alias("is_editorial"), F.lit(True).alias("is_active"))
    return expire(facts, _as_of()).groupBy("event_type", "is_active").agg(F.count("*").alias("n"))


def sliding_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within an hour per user, and whether each is within five."""
    limited = within_window(_events(spark, sf_dir), "user_id", "ts", 3600, 5)
    return limited.select("event_id", "in_window", "allowed")


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts from a stream that holds a window of counts for each user."""
    stream, folder = _stream(spark, sf_dir)
    limited = lambda events: rate_limited(events.select("event_id", "user_id", "ts"), "user_id", "ts", 3600, 5)
    with keyed_state(spark):
        append_and_close(stream, limited, "ts", f"{folder}/out", f"{folder}/state", f"{folder}/markers")
    return spark.read.parquet(f"{folder}/out").select("event_id", "in_window", "allowed")


def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes by type, each user's once, from two feeds with replays: a batch run again, a feed read again, a fold between."""
    stream, folder = _stream(spark, sf_dir)
    votes, path, kinds = stream.select("event_type", "user_id"), f"{folder}/counters", _events(spark, sf_dir).select("event_type").schema
    increment_available(votes, path, f"{folder}/first", "site", ["event_type"], "user_id")
    batch = _events(spark, sf_dir).select("event_type", "user_id")
    increment(batch, 0, path, "site", ["event_type"], "user_id")
    fold(spark, path, kinds)
    increment(batch, 0, path, "site", ["event_type"], "user_id")
    increment_available(votes, path, f"{folder}/second", "app", ["event_type"], "user_id")
    increment(batch, 1, path, "plain", ["event_type"])
    increment(batch, 1, path, "plain", ["event_type"])
    total = counts(spark, path, kinds)
    known = _events(spark, sf_dir).select("event_type").where("event_type <> 'error'").distinct().withColumn("votes", F.lit(10).cast("bigint"))
    return total.join(added_to(known, total, ["event_type"], "votes"), "event_type", "left")


def vote_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the event type most voted for, with its trust level."""
    votes = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("votes"))
    return argmax_rows(votes, ["user_id"], "votes", ["event_type"]).withColumn("trust", trust_level(F.col("votes")))


def first_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes from the 20th on, by users who had cast none of the kind in the first two days."""
    base, new = _halves(spark, sf_dir)
    late = new.where("ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    return not_yet(late, base.where("ts < TIMESTAMP_NTZ '2024-01-03 00:00:00'"), ["user_id", "event_type"]).groupBy("event_type").agg(F.count("*").alias("n"))


def recent_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen newest events with their age: a top-k report."""
    newest = _events(spark, sf_dir).where(F.col("ts") <= _as_of()).orderBy(F.desc("ts"), "event_id").limit(15)
    return newest.select("event_id", "event_type", relative_time(F.col("ts"), _as_of()).alias("age"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: user number gives the column, the minute of the hour the row."""
    return _events(spark, sf_dir).select("event_id", "event_type", ((F.col("user_id") % 10) + 0.5).alias("lon"), (F.minute("ts") / F.lit(6.0) + 0.05).alias("lat"))


def _squares(spark: SparkSession) -> DataFrame:
    """Twenty-five squares of side 2 less a margin, so some points are outside all."""
    corner = lambda x, y: F.struct((F.col("x") * 2.0 + x).alias("lon"), (F.col("y") * 2.0 + y).alias("lat"))
    grid = spark.range(25).select((F.col("id") % 5).alias("x"), F.floor(F.col("id") / 5).alias("y"), F.col("id").alias("area"))
    return grid.select("area", F.array(corner(0.0, 0.0), corner(1.7, 0.0), corner(1.7, 1.7), corner(0.0, 1.7)).alias("ring"))


def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points per square and type."""
    return counts_by_area(_points(spark, sf_dir), _squares(spark), "area", "event_type")


def nearest_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containing square of every point, else the one with the nearest centre."""
    placed = locate_or_nearest(_points(spark, sf_dir), _squares(spark), "event_id", "area")
    return placed.groupBy("area", "how").agg(F.count("*").alias("n"))


def _diamonds(spark: SparkSession) -> DataFrame:
    """Areas of very different size in one table: a country, diamonds of a ward's width, and ten of a hundredth."""
    corners = F.array(*(F.struct((F.col("x") + dx * F.col("r")).alias("lon"), (F.col("y") + dy * F.col("r")).alias("lat")) for dx, dy in ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0))))
    wards = spark.range(16).selectExpr("id AS area", "(id % 4) * 3 + 0.9D AS x", "floor(id / 4) * 3 + 0.9D AS y", "1.27D AS r")
    small = spark.range(10).selectExpr("100 + id AS area", "id + 0.5D AS x", "5.05D AS y", "0.01D AS r")
    country = spark.range(1).selectExpr("1000 AS area", "0.0D AS x", "0.0D AS y", "5000.0D AS r")
    return wards.unionByName(small).unionByName(country).select("area", corners.alias("ring"))


def areas_of_all_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points per area and type where the areas overlap and differ in size by five orders."""
    return counts_by_area(_points(spark, sf_dir), _diamonds(spark), "area", "event_type")


def nearest_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest customer's place for every event; one event in fifty is a thousand widths away."""
    far = F.when(F.col("event_id") % 50 == 0, 10_000.0).otherwise(0.0)
    points = _points(spark, sf_dir).select("event_id", (F.col("lon") + far).alias("lon"), (F.col("lat") - far).alias("lat"))
    spread = lambda a, m: F.pmod(F.col("c_custkey") * a, F.lit(m)) / F.lit(m / 10.0)
    middles = table(spark, sf_dir, "customer").select("c_custkey", F.struct(spread(7919, 1009).alias("lon"), spread(104729, 997).alias("lat")).alias("mid"))
    return nearest(points, middles, "event_id", "c_custkey")


def pin_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old and the new ward of every point, and whether it has an old one; the schemes' areas differ."""
    old = _squares(spark).select(F.col("area").alias("ward_no"), F.concat(F.lit("Ward "), "area").alias("ward_name"), "ring")
    new = _diamonds(spark).where("area < 100").select(F.col("area").alias("ward_no"), (F.col("area") % 5).alias("corporation"), "ring")
    return pin_lookup(_points(spark, sf_dir), "event_id", old=(old, "ward_no"), new=(new, "ward_no"))


def area_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the corners of the box around each user's points."""
    low = lambda c: F.min(c)
    boxes = _points(spark, sf_dir).groupBy("event_type").agg(low("lon").alias("x0"), F.max("lon").alias("x1"), low("lat").alias("y0"), F.max("lat").alias("y1"))
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    mid = centroid(F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))
    return boxes.select("event_type", F.round(mid["lon"], 6).alias("lon"), F.round(mid["lat"], 6).alias("lat"))


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Events as a file stream (timestamps with zone, as watermarks need) and a fresh folder for its output."""
    folder = shared_folder(spark)
    schema = _events(spark, sf_dir).schema
    # A glob, since the table may be one file or a folder of them.
    stream = file_stream(spark, f"{sf_dir}/events.parquet*", schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")), folder


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, one row per place, appended by a stream that reads what is there."""
    stream, folder = _stream(spark, sf_dir)
    places = F.when(F.col("event_type") == "error", F.array(F.lit(1), F.lit(2)))
    fanned = per_place(deduplicated(stream, ["event_id"], "ts"), places).select("event_id", "event_type", "place")
    append_available(fanned, f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").groupBy("event_type", "place").agg(F.count("*").alias("n"))


def stream_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events fed twice: the second run inserts nothing."""
    stream, folder = _stream(spark, sf_dir)
    for run in ("first", "second"):
        insert_new_available(stream.select("event_id", "event_type", "value"), f"{folder}/out", f"{folder}/{run}", ["event_id"])
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts per type from a stream that is closed when all is read."""
    stream, folder = _stream(spark, sf_dir)
    append_and_close(stream, lambda events: windowed_counts(events, "ts", "event_type"), "ts", f"{folder}/out", f"{folder}/state", f"{folder}/markers")
    return spark.read.parquet(f"{folder}/out").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User sessions (30 minutes apart) from a stream that is closed when all is read."""
    stream, folder = _stream(spark, sf_dir)
    append_and_close(stream, lambda events: sessions(events, "ts", "user_id"), "ts", f"{folder}/out", f"{folder}/state", f"{folder}/markers")
    return spark.read.parquet(f"{folder}/out").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


HALVES_SQL = """
base AS (SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00'),
new AS (SELECT event_id, ts, user_id, event_type, value * 2 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00')"""

POINTS_SQL = """
points AS (SELECT event_id, event_type, user_id % 10 + 0.5::DOUBLE AS lon, minute(ts) / 6.0::DOUBLE + 0.05::DOUBLE AS lat FROM events),
squares AS (SELECT i AS area, (i % 5) * 2.0::DOUBLE AS x, (i // 5) * 2.0::DOUBLE AS y FROM range(25) r(i)),
inside AS (SELECT event_id, event_type, area FROM points JOIN squares ON lon >= x AND lon < x + 1.7 AND lat >= y AND lat < y + 1.7)"""

RATE_SQL = """
WITH t AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
w AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS in_window FROM t)
SELECT event_id, in_window, in_window <= 5 AS allowed FROM w"""

DIAMONDS_SQL = """
diamonds AS (
  SELECT i AS area, (i % 4) * 3 + 0.9::DOUBLE AS x, (i // 4) * 3 + 0.9::DOUBLE AS y, 1.27::DOUBLE AS r FROM range(16) t(i)
  UNION ALL SELECT 100 + i, i + 0.5::DOUBLE, 5.05::DOUBLE, 0.01::DOUBLE FROM range(10) t(i) UNION ALL SELECT 1000, 0, 0, 5000)"""

QUERIES = {
    f.__name__: f
    for f in (
        top_events_window, table_freshness, health_verdict, event_counters, merge_upsert, merge_insert_ignore, merge_replace_partition, merge_partial_upsert, merge_update_from,
        union_sources, expire_facts, sliding_rate_limit, stream_rate_limit, stream_counters, vote_argmax, first_votes, recent_feed, point_in_polygon, nearest_area, areas_of_all_sizes, nearest_outliers, pin_lookups, area_centroids,
        stream_append, stream_insert_ignore, stream_windows, stream_sessions,
    )
}
FRESH_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS total, count(*) FILTER (WHERE {c} > m - INTERVAL 24 HOUR AND {c} <= m) AS last_24h, count(*) FILTER (WHERE {c} > m - INTERVAL 7 DAY AND {c} <= m) AS last_7d, max({c}) AS latest, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status FROM {t}, (SELECT TIMESTAMP '{MOMENT}' AS m)"
    for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))
) + " UNION ALL SELECT 'missing', NULL, NULL, NULL, NULL, 'error'"
ORACLES = {
    "top_events_window": f"SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL AND ts > TIMESTAMP '{MOMENT}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{MOMENT}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "table_freshness": f"SELECT table_name, total, last_24h, last_7d, CAST(latest AS VARCHAR) AS latest, status FROM ({FRESH_SQL})",
    "health_verdict": f"""
WITH f AS ({FRESH_SQL}), v AS (SELECT coalesce(max(latest) FILTER (WHERE table_name = 'lineitem') <= TIMESTAMP '{MOMENT}' - INTERVAL 48 HOUR, true) AS stale, count(*) FILTER (WHERE table_name IN ('events', 'orders') AND status <> 'ok') AS core_not_ok, count(*) FILTER (WHERE status = 'error') AS errors, count(*) AS n FROM f)
SELECT stale, core_not_ok, errors, CASE WHEN errors = n THEN 'down' WHEN stale OR core_not_ok > 0 OR errors > 0 THEN 'degraded' ELSE 'ok' END AS verdict FROM v""",
    "event_counters": f"""
SELECT event_type, count(*) AS total, count(*) FILTER (WHERE ts > TIMESTAMP '{MOMENT}' - INTERVAL 1 DAY AND ts <= TIMESTAMP '{MOMENT}') AS last_24h, count(*) FILTER (WHERE ts > TIMESTAMP '{MOMENT}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{MOMENT}') AS last_7d,
       count(DISTINCT user_id) AS users, CAST(sum(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1""",
    "merge_upsert": f"WITH {HALVES_SQL} SELECT * FROM new UNION ALL SELECT * FROM base WHERE event_id NOT IN (SELECT event_id FROM new)",
    "merge_insert_ignore": f"WITH {HALVES_SQL} SELECT * FROM base UNION ALL SELECT * FROM new WHERE event_id NOT IN (SELECT event_id FROM base)",
    "merge_replace_partition": f"WITH {HALVES_SQL} SELECT * FROM base WHERE event_type IS DISTINCT FROM 'error' UNION ALL SELECT * FROM new WHERE event_type = 'error'",
    "merge_partial_upsert": f"""
WITH {HALVES_SQL} SELECT coalesce(b.event_id, n.event_id) AS event_id, coalesce(b.ts, n.ts) AS ts, coalesce(b.user_id, n.user_id) AS user_id, coalesce(b.event_type, 'changed') AS event_type, coalesce(n.value, b.value) AS value
FROM base b FULL JOIN new n ON b.event_id = n.event_id""",
    "merge_update_from": f"WITH {HALVES_SQL} SELECT b.event_id, b.ts, b.user_id, b.event_type, coalesce(n.value, b.value) AS value FROM base b LEFT JOIN new n ON b.event_id = n.event_id",
    "union_sources": f"WITH {HALVES_SQL} SELECT event_id, event_type, value FROM new UNION ALL SELECT event_id, event_type, value FROM base WHERE event_id NOT IN (SELECT event_id FROM new)",
    "expire_facts": f"SELECT event_type, NOT (ts + INTERVAL 10 DAY < TIMESTAMP '{MOMENT}' AND event_type <> 'purchase') AS is_active, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_rate_limit": RATE_SQL,
    "stream_rate_limit": RATE_SQL,
    "stream_counters": """
WITH c AS (SELECT event_type, count(*) + count(DISTINCT user_id) AS n FROM events GROUP BY 1)
SELECT event_type, n, CASE WHEN event_type <> 'error' THEN n + 10 END AS votes FROM c""",
    "vote_argmax": """
WITH v AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS rn FROM v)
SELECT user_id, event_type, votes, CASE WHEN votes >= 5 THEN 'community_verified' ELSE 'unverified' END AS trust FROM r WHERE rn = 1""",
    "first_votes": """
SELECT event_type, count(*) AS n FROM events e WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'
AND NOT EXISTS (SELECT 1 FROM events b WHERE b.ts < TIMESTAMP '2024-01-03 00:00:00' AND b.user_id = e.user_id AND b.event_type = e.event_type) GROUP BY 1""",
    "recent_feed": f"""
WITH r AS (SELECT event_id, event_type, ts, CAST(floor((epoch(TIMESTAMP '{MOMENT}') - floor(epoch(ts))) / 60) AS BIGINT) AS m FROM events WHERE ts <= TIMESTAMP '{MOMENT}' ORDER BY ts DESC, event_id LIMIT 15)
SELECT event_id, event_type, CASE WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS age FROM r""",
    "point_in_polygon": f"WITH {POINTS_SQL} SELECT area, event_type, count(*) AS points FROM inside GROUP BY 1, 2",
    "nearest_area": f"""
WITH {POINTS_SQL}, outside AS (SELECT * FROM points WHERE event_id NOT IN (SELECT event_id FROM inside)),
near AS (SELECT event_id, area, row_number() OVER (PARTITION BY event_id ORDER BY (lon - (x + 0.85)) * (lon - (x + 0.85)) + (lat - (y + 0.85)) * (lat - (y + 0.85)), area) AS rn FROM outside CROSS JOIN squares)
SELECT area, 'contains' AS how, count(*) AS n FROM inside GROUP BY 1 UNION ALL SELECT area, 'nearest', count(*) FROM near WHERE rn = 1 GROUP BY 1""",
    "areas_of_all_sizes": f"""
WITH {POINTS_SQL}, {DIAMONDS_SQL} SELECT area, event_type, count(*) AS points FROM points JOIN diamonds d ON abs(lon - d.x) + abs(lat - d.y) < r GROUP BY 1, 2""",
    "nearest_outliers": f"""
WITH {POINTS_SQL}, moved AS (SELECT event_id, lon + CASE WHEN event_id % 50 = 0 THEN 10000 ELSE 0 END AS lon, lat - CASE WHEN event_id % 50 = 0 THEN 10000 ELSE 0 END AS lat FROM points),
centres AS (SELECT c_custkey, (c_custkey * 7919 % 1009) / 100.9::DOUBLE AS x, (c_custkey * 104729 % 997) / 99.7::DOUBLE AS y FROM customer)
SELECT event_id, arg_min(c_custkey, ((lon - x) * (lon - x) + (lat - y) * (lat - y), c_custkey)) AS c_custkey FROM moved, centres GROUP BY event_id""",
    "pin_lookups": f"""
WITH {POINTS_SQL}, {DIAMONDS_SQL},
o AS (SELECT event_id, min(area) AS a FROM inside GROUP BY 1), n AS (SELECT event_id, min(area) AS a FROM points JOIN diamonds d ON area < 100 AND abs(lon - d.x) + abs(lat - d.y) < r GROUP BY 1)
SELECT p.event_id, o.a IS NOT NULL AS found, o.a AS old_ward_no, 'Ward ' || o.a AS old_ward_name, n.a AS new_ward_no, n.a % 5 AS new_corporation FROM points p LEFT JOIN o USING (event_id) LEFT JOIN n USING (event_id)""",
    "area_centroids": f"WITH {POINTS_SQL} SELECT event_type, round((min(lon) + max(lon)) / 2, 6) AS lon, round((min(lat) + max(lat)) / 2, 6) AS lat FROM points GROUP BY 1",
    "stream_append": """
SELECT event_type, CAST(NULL AS INT) AS place, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1
UNION ALL SELECT event_type, p, count(*) FROM events CROSS JOIN (VALUES (1), (2)) v(p) WHERE event_type = 'error' GROUP BY 1, 2""",
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sessions": """
WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)
SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY 1""",
    "stream_insert_ignore": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
}
