"""Queries through SQL text and table functions, and the nested profiles that a page asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators import sql_surface
from tallybook.operators.merge import flag_by_pattern, flagged_counts
from tallybook.operators.profile import ward_profiles
from tallybook.session import table

MOMENT = "2024-01-28 00:00:00"


def _views(spark: SparkSession, sf_dir: str) -> None:
    """Events as analytics and as community activity, nations as wards, and their figures."""
    events, nations, customers, suppliers = (table(spark, sf_dir, t) for t in ("events", "nation", "customer", "supplier"))
    wards = nations.select(F.col("n_nationkey").alias("ward_no"), F.col("n_name").alias("ward_name"), F.concat(F.lit("AC "), "n_regionkey").alias("assembly_constituency"))
    placed = events.withColumn("ward_no", F.when(F.col("user_id") % 9 != 0, (F.col("user_id") % 27).cast("int")))
    named = placed.join(wards.select("ward_no", "ward_name"), "ward_no", "left").select(F.col("event_type").alias("event"), "ward_name", F.col("ts").alias("created_at"))
    activity = placed.select(F.col("event_type").alias("kind"), "ward_no", F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    segment = lambda s: F.count_if(F.col("c_mktsegment") == s).cast("double")
    people = customers.groupBy(F.col("c_nationkey").alias("ward_no")).agg(
        (F.count("*") * 1000.0).alias("population"), (F.count("*") * 7.0).alias("households"), F.round(F.sum(F.abs("c_acctbal")) / 1000, 0).alias("road_length_km"), segment("BUILDING").alias("lakes"), segment("MACHINERY").alias("parks"),
        segment("AUTOMOBILE").alias("playgrounds"), segment("HOUSEHOLD").alias("govt_schools"), segment("FURNITURE").alias("trees"), F.count_if(F.col("c_acctbal") < 0).cast("double").alias("working_streetlights"),
    )
    works = suppliers.groupBy(F.col("s_nationkey").alias("ward_no")).agg(*(F.count_if(F.col("s_suppkey") % k == 0).cast("double").alias(c) for k, c in ((1, "police_stations"), (2, "fire_stations"), (3, "bus_stops"), (4, "bus_routes"), (5, "streetlights"), (6, "namma_clinics"), (7, "dwcc_count"))))
    stats = wards.join(people, "ward_no", "left").join(works, "ward_no", "left").select(
        "*", (F.col("ward_no") % 4).cast("double").alias("area_sqkm"), (F.lit(2020) + F.col("ward_no") % 3).cast("int").alias("data_year"), F.concat(F.lit("census "), F.col("ward_no") % 2).alias("source"))
    sql_surface.register({"analytics_events": named, "community_activity": activity, "wards": wards, "ward_stats": stats})
    sql_surface.create_functions(spark)


def sql_top_wards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten wards with most purchases of the last 1, 7 and 20 days: a table function called for each row of a list (a top-k report)."""
    _views(spark, sf_dir)
    text = "SELECT days, t.ward_name, t.count FROM VALUES (1), (7), (20) AS spans(days), LATERAL top_event_wards(:event, CAST(:as_of AS TIMESTAMP_NTZ), days) AS t"
    return sql_surface.query(spark, text, event="purchase", as_of=MOMENT)


def sql_recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty activities with their ward's name, if they have one: a top-k report."""
    _views(spark, sf_dir)
    return sql_surface.query(spark, "SELECT * FROM recent_activity(CAST(:as_of AS TIMESTAMP_NTZ), :most)", as_of=MOMENT, most=20)


def sql_ward_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of every constituency, and one asked for by name."""
    _views(spark, sf_dir)
    whole, one = sql_surface.call(spark, "ward_stats_by_ac"), sql_surface.call(spark, "ward_stats_by_ac", p_ac="AC 2")
    return whole.withColumn("asked", F.lit("all")).unionByName(one.withColumn("asked", F.lit("one")))


def full_ward_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ward's nested profile, its parts as JSON."""
    events, nations, customers, suppliers, orders = (table(spark, sf_dir, t) for t in ("events", "nation", "customer", "supplier", "orders"))
    wards = nations.select(F.col("n_nationkey").alias("ward_no"), F.concat(F.lit("AC "), "n_regionkey").alias("assembly_constituency"))
    reps = nations.select(F.concat(F.lit("AC "), "n_regionkey").alias("assembly_constituency"), F.when(F.col("n_nationkey") % 2 == 0, "MLA").otherwise("MP").alias("role"), F.col("n_name").alias("name")).where("assembly_constituency <> 'AC 4'")
    officers = suppliers.select(F.col("s_nationkey").alias("ward_no"), F.lit("engineer").alias("role"), F.col("s_name").alias("name"))
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    tenders = placed.select(F.col("c_nationkey").alias("ward_no"), F.col("o_orderkey").alias("tender_id"), F.concat(F.lit("Works "), "o_orderpriority").alias("title"), F.round(F.col("o_totalprice") / 1000).cast("bigint").alias("value_lakh"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued_date")).where("ward_no <> 3")
    alerts = events.where("event_type = 'error'").select(F.when(F.col("user_id") % 5 != 0, (F.col("user_id") % 30).cast("int")).alias("ward_no"), F.concat(F.lit("Alert "), "event_id").alias("title"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("since"))
    kinds = F.element_at(F.array(*(F.lit(k) for k in ("official", "rti", "community", "community", "community"))), (F.col("event_id") % 5 + 1).cast("int"))
    facts = events.where("event_type = 'view'").select((F.col("user_id") % 25).cast("int").alias("ward_no"), F.col("event_id").alias("id"), F.lit("road").alias("subject"), F.concat(F.lit("v"), "event_id").alias("value"), kinds.alias("source_type"), (F.col("event_id") % 8).alias("corroboration_count"), (F.col("event_id") % 6).alias("dispute_count"), (F.col("event_id") % 11 != 0).alias("is_active"))
    profile = ward_profiles(wards, reps, officers, tenders, alerts, facts, most=4)
    nested = ("elected_reps", "officers", "tenders", "governance_alert", "community_facts")
    return profile.select("ward_no", "assembly_constituency", "tender_count", "tender_total_lakh", *(F.to_json(c).alias(c) for c in nested))


def vendor_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers flagged by two patterns, and how many there are and carry a flag after each."""
    suppliers = table(spark, sf_dir, "supplier").withColumn("blacklist_flags", F.array().cast("array<string>"))
    runs = {"7": flag_by_pattern(suppliers, "s_name", ["7"], "a"), "none": suppliers, "8 or 9": flag_by_pattern(suppliers, "s_name", ["8", "9"], "b")}
    return reduce(DataFrame.unionByName, [flagged_counts(df).withColumn("run", F.lit(name)) for name, df in runs.items()])


PLACED_SQL = "placed AS (SELECT *, CASE WHEN user_id % 9 <> 0 THEN CAST(user_id % 27 AS INT) END AS ward_no FROM events)"
STATS_SQL = """
people AS (SELECT c_nationkey AS w, count(*) * 1000.0::DOUBLE AS population, count(*) * 7.0::DOUBLE AS households, round(sum(abs(c_acctbal)) / 1000, 0) AS road_length_km, count(*) FILTER (c_mktsegment = 'BUILDING') AS lakes, count(*) FILTER (c_mktsegment = 'MACHINERY') AS parks,
  count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS playgrounds, count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS govt_schools, count(*) FILTER (c_mktsegment = 'FURNITURE') AS trees, count(*) FILTER (c_acctbal < 0) AS working FROM customer GROUP BY 1),
works AS (SELECT s_nationkey AS w, count(*) AS s1, count(*) FILTER (s_suppkey % 2 = 0) AS s2, count(*) FILTER (s_suppkey % 3 = 0) AS s3, count(*) FILTER (s_suppkey % 4 = 0) AS s4, count(*) FILTER (s_suppkey % 5 = 0) AS s5, count(*) FILTER (s_suppkey % 6 = 0) AS s6, count(*) FILTER (s_suppkey % 7 = 0) AS s7 FROM supplier GROUP BY 1),
stats AS (SELECT 'AC ' || n_regionkey AS assembly_constituency, sum(population) AS total_population, sum((n_nationkey % 4)::DOUBLE) AS total_area_sqkm, sum(households) AS total_households, sum(road_length_km) AS total_road_length_km, sum(lakes)::DOUBLE AS total_lakes, sum(parks)::DOUBLE AS total_parks,
  sum(playgrounds)::DOUBLE AS total_playgrounds, sum(govt_schools)::DOUBLE AS total_govt_schools, sum(s1)::DOUBLE AS total_police_stations, sum(s2)::DOUBLE AS total_fire_stations, sum(s3)::DOUBLE AS total_bus_stops, sum(s4)::DOUBLE AS total_bus_routes, sum(s5)::DOUBLE AS total_streetlights,
  sum(working)::DOUBLE AS streetlights, sum(trees)::DOUBLE AS trees, sum(s6)::DOUBLE AS namma_clinics, sum(s7)::DOUBLE AS dwcc_count, round(avg(population / nullif(n_nationkey % 4, 0)), 2) AS avg_population_density, count(*) AS ward_count, CAST(max(2020 + n_nationkey % 3) AS INT) AS data_year,
  string_agg(DISTINCT 'census ' || n_nationkey % 2, ', ' ORDER BY 'census ' || n_nationkey % 2) AS source FROM nation LEFT JOIN people ON people.w = n_nationkey LEFT JOIN works ON works.w = n_nationkey GROUP BY 1)"""

QUERIES = {f.__name__: f for f in (sql_top_wards, sql_recent_activity, sql_ward_stats, full_ward_profiles, vendor_flag_counts)}
ORACLES = {
    "sql_top_wards": f"""
WITH {PLACED_SQL}, c AS (SELECT days, n_name AS ward_name, count(*) AS count FROM placed JOIN nation ON ward_no = n_nationkey JOIN (VALUES (1), (7), (20)) s(days) ON ts >= TIMESTAMP '{MOMENT}' - to_days(days) AND ts <= TIMESTAMP '{MOMENT}' WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT days, ward_name, count FROM (SELECT *, row_number() OVER (PARTITION BY days ORDER BY count DESC, ward_name) AS r FROM c) WHERE r <= 10""",
    "sql_recent_activity": f"""
WITH {PLACED_SQL} SELECT CAST(row_number() OVER (ORDER BY ts DESC, event_id) AS INT) AS place, event_type AS kind, event_id AS id, ward_no, n_name AS ward_name, ts AS created_at
FROM (SELECT * FROM placed WHERE ts <= TIMESTAMP '{MOMENT}' ORDER BY ts DESC, event_id LIMIT 20) LEFT JOIN nation ON ward_no = n_nationkey""",
    "sql_ward_stats": f"WITH {STATS_SQL} SELECT *, 'all' AS asked FROM stats UNION ALL SELECT *, 'one' FROM stats WHERE assembly_constituency = 'AC 2'",
    "full_ward_profiles": """
WITH w AS (SELECT n_nationkey AS ward_no, 'AC ' || n_regionkey AS ac FROM nation),
reps AS (SELECT 'AC ' || n_regionkey AS ac, CASE WHEN n_nationkey % 2 = 0 THEN 'MLA' ELSE 'MP' END AS role, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 2, n_name) AS r FROM nation WHERE n_regionkey <> 4),
rj AS (SELECT ac, '[' || string_agg('{"role":"' || role || '","name":"' || name || '"}', ',' ORDER BY r) || ']' AS j FROM reps WHERE r <= 4 GROUP BY 1),
o AS (SELECT s_nationkey AS ward_no, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS r FROM supplier),
oj AS (SELECT ward_no, '[' || string_agg('{"role":"engineer","name":"' || s_name || '"}', ',' ORDER BY r) || ']' AS j FROM o WHERE r <= 4 GROUP BY 1),
t AS (SELECT c_nationkey AS ward_no, o_orderkey AS id, 'Works ' || o_orderpriority AS title, CAST(round(o_totalprice / 1000) AS BIGINT) AS v, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3),
tr AS (SELECT *, row_number() OVER (PARTITION BY ward_no ORDER BY d DESC, id) AS r FROM t),
tj AS (SELECT ward_no, count(*) AS n, sum(v)::DOUBLE AS total, '[' || string_agg('{"tender_id":' || id || ',"title":"' || title || '","value_lakh":' || v || ',"issued_date":"' || d || '"}', ',' ORDER BY r) FILTER (r <= 4) || ']' AS j FROM tr GROUP BY 1),
al AS (SELECT CASE WHEN user_id % 5 <> 0 THEN CAST(user_id % 30 AS INT) END AS ward_no, 'Alert ' || event_id AS title, strftime(ts, '%Y-%m-%d %H:%M:%S') AS since FROM events WHERE event_type = 'error'),
aj AS (SELECT ward_no, arg_max('{"title":"' || title || '","since":"' || since || '"}', (since, title)) AS j FROM al GROUP BY 1),
f AS (SELECT CAST(user_id % 25 AS INT) AS ward_no, event_id AS id, event_id % 8 AS c, event_id % 6 AS x, event_id % 5 AS k FROM events WHERE event_type = 'view' AND event_id % 11 <> 0),
fr AS (SELECT *, row_number() OVER (PARTITION BY ward_no ORDER BY c DESC, id) AS r, CASE WHEN k = 0 THEN 'official' WHEN k = 1 THEN 'rti' WHEN x > 0 AND x >= c THEN 'disputed' WHEN c >= 5 THEN 'community_verified' ELSE 'unverified' END AS trust FROM f),
fj AS (SELECT ward_no, '[' || string_agg('{"id":' || id || ',"subject":"road","value":"v' || id || '","trust_level":"' || trust || '"}', ',' ORDER BY r) || ']' AS j FROM fr WHERE r <= 4 GROUP BY 1)
SELECT w.ward_no, w.ac AS assembly_constituency, coalesce(tj.n, 0) AS tender_count, coalesce(tj.total, 0) AS tender_total_lakh, coalesce(rj.j, '[]') AS elected_reps, coalesce(oj.j, '[]') AS officers, coalesce(tj.j, '[]') AS tenders,
  coalesce(aj.j, (SELECT j FROM aj WHERE ward_no IS NULL)) AS governance_alert, coalesce(fj.j, '[]') AS community_facts
FROM w LEFT JOIN rj ON rj.ac = w.ac LEFT JOIN oj ON oj.ward_no = w.ward_no LEFT JOIN tj ON tj.ward_no = w.ward_no LEFT JOIN aj ON aj.ward_no = w.ward_no LEFT JOIN fj ON fj.ward_no = w.ward_no""",
    "vendor_flag_counts": """
SELECT run, count(*) AS total, count(*) FILTER (f) AS flagged FROM (
  SELECT '7' AS run, contains(s_name, '7') AS f FROM supplier UNION ALL SELECT 'none', false FROM supplier UNION ALL SELECT '8 or 9', contains(s_name, '8') OR contains(s_name, '9') FROM supplier) GROUP BY 1""",
}
