"""Lookups and small reports: predicates, aliases, updates, nested bundles, feeds in editorial order, jurisdictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import bands
from tallybook.functions.text import cache_key, money_label, representative_label, rounded
from tallybook.operators.joins import by_number_else_name, canonical, update_by_prefix_else_word
from tallybook.operators.merge import flag_by_pattern
from tallybook.operators.ranking import latest, top_per_group
from tallybook.operators.rollup import count_where, share_of_total
from tallybook.operators.spatial import jurisdictions
from tallybook.session import table


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def customer_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality, range, membership, contains, prefix and not-null predicates together; all reach the scan or the filter above it."""
    (customers,) = _tables(spark, sf_dir, "customer")
    name = F.col("c_name")
    chosen = customers.where(F.col("c_acctbal").isNotNull() & (F.col("c_acctbal") >= 1000) & (F.col("c_acctbal") < 9000) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return chosen.where(name.ilike("%#0000%") & F.lower(name).startswith("customer") & (F.col("c_nationkey") != 3)).select("c_custkey", "c_name", "c_acctbal")


def stats_by_constituency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and averages of ward figures per constituency."""
    customers, nations = _tables(spark, sf_dir, "customer", "nation")
    wards = customers.groupBy("c_nationkey").agg(F.count("*").alias("people"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("balance"))
    joined = nations.join(wards, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.groupBy("n_regionkey").agg(
        F.count("*").alias("ward_count"), F.sum("people").alias("people"), F.sum("balance").cast("double").alias("balance"), F.round(F.avg("people"), 6).alias("people_per_ward")
    )


def budget_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each department's amount in crore and its share of the year's total."""
    lines, parts = _tables(spark, sf_dir, "lineitem", "part")
    sums = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.year("l_shipdate").alias("fy"), F.col("p_type").alias("department")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))
    return share_of_total(sums, "amount", "fy").select("fy", "department", rounded(F.col("amount").cast("double") / 1e7, 4).alias("amount_cr"), "share_pct")


def ward_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ward's nested card: totals, latest orders and vendors, as JSON."""
    nations, customers, orders, suppliers = _tables(spark, sf_dir, "nation", "customer", "orders", "supplier")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    recent = top_per_group(placed, ["c_nationkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 3)
    latest_orders = recent.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("rank", "o_orderkey"))).alias("orders"))
    totals = placed.groupBy("c_nationkey").agg(F.count("*").alias("order_count"))
    vendors = suppliers.groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_suppkey")).alias("vendors"))  # a ward's vendors: bounded
    joined = nations.join(latest_orders, F.col("n_nationkey") == F.col("c_nationkey"), "left").drop("c_nationkey").join(totals, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(vendors, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return joined.select("n_nationkey", "order_count", F.to_json("orders.o_orderkey").alias("orders"), F.coalesce(F.to_json("vendors"), F.lit("[]")).alias("vendors"))


def latest_three_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each ward in its three latest years."""
    orders, customers = _tables(spark, sf_dir, "orders", "customer")
    yearly = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.year("o_orderdate").alias("fy")).agg(F.count("*").alias("n"))
    return latest(yearly, ["c_nationkey"], "fy", 3)


ALIASES = [("europe", "EU"), ("Asia", "AS"), ("MIDDLE EAST", "ME")]


def canonical_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region names by their alias table; unknown names stay."""
    aliases = spark.createDataFrame(ALIASES, "alias string, canonical string")
    return canonical(table(spark, sf_dir, "region"), "r_name", aliases)


def contact_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments set on wards whose name starts with an update's name, else holds its last word."""
    wards = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("phone"), F.col("n_nationkey").alias("ward_no"))
    updates = spark.createDataFrame([("NATION_2", "222"), ("The tion_11", "111")], "name string, phone string")
    return update_by_prefix_else_word(wards, updates, "name", ["phone"])


def spend_by_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spending joined by ward number, and by name where the number is missing."""
    nations, suppliers = _tables(spark, sf_dir, "nation", "supplier")
    spine = nations.select(F.col("n_nationkey").alias("ward_no"), F.col("n_name").alias("ward_name"))
    sums = suppliers.groupBy("s_nationkey").agg(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("spend"))
    fact = spine.join(sums, F.col("ward_no") == F.col("s_nationkey")).select(F.when(F.col("ward_no") < 10, F.col("ward_no")).alias("ward_no"), F.concat(F.lit(" "), F.lower("ward_name")).alias("ward_name"), "spend")
    return by_number_else_name(spine, fact, "ward_no", "ward_name", ["spend"])


def editorial_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty events, editorial ones first, then the newest: a top-k report."""
    events = table(spark, sf_dir, "events").withColumn("is_editorial", F.col("event_type") == "signup")
    return events.orderBy(F.desc("is_editorial"), F.desc("ts"), "event_id").limit(20).select("event_id", "is_editorial")


def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty oldest errors: a top-k report."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").orderBy("ts", "event_id").limit(20).select("event_id")


def point_jurisdictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event as a point, the boundaries around it by type; counted by what they are."""
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10 + 0.5).alias("lon"), (F.minute("ts") / F.lit(6.0) + 0.05).alias("lat"))
    corner = lambda x, y: F.struct((F.col("x") + x).alias("lon"), (F.col("y") + y).alias("lat"))
    squares = lambda side, kind: spark.range(int((10 // side) ** 2)).select((F.col("id") % (10 // side) * float(side)).alias("x"), (F.floor(F.col("id") / (10 // side)) * float(side)).alias("y"), "id").select(
        F.lit(kind).alias("type"), F.concat(F.lit(kind), F.col("id")).alias("name"), F.array(corner(0.0, 0.0), corner(float(side), 0.0), corner(float(side), float(side)), corner(0.0, float(side))).alias("ring")
    )
    found = jurisdictions(events, squares(5, "zone").unionByName(squares(2, "ward")), "event_id")
    named = found.select(F.get(F.col("jurisdictions")["ward"], F.lit(0)).alias("ward"), F.get(F.col("jurisdictions")["zone"], F.lit(0)).alias("zone"))
    return named.groupBy("ward", "zone").agg(F.count("*").alias("n"))


def indicator_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the bands that air and water figures have."""
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    banded = table(spark, sf_dir, "part").select(
        bands.pm25_band(size).alias("pm25"), bands.pm10_band(size * 2).alias("pm10"), bands.oxygen_band(size / 5).alias("oxygen"), bands.oxygen_demand_band(size / 5).alias("bod"),
        bands.coliform_band(price * 3).alias("coliform"), bands.water_class_band(F.substring("p_type", 1, 1)).alias("water"), bands.deduction_band(size / 2).alias("deduction"),
    )
    return banded.groupBy(*banded.columns).agg(F.count("*").alias("n"))


def vendor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of suppliers as a page shows them, with flags by name pattern."""
    suppliers = table(spark, sf_dir, "supplier").withColumn("blacklist_flags", F.array().cast("array<string>"))
    flagged = flag_by_pattern(suppliers, "s_name", ["#00000000", "007"], "pattern")
    label = representative_label(F.col("s_name"), F.when(F.col("s_acctbal") < 0, "owing"), F.col("s_nationkey"))
    return flagged.select("s_suppkey", label.alias("label"), money_label(F.col("s_suppkey").cast("double")).alias("money"), F.size("blacklist_flags").cast("bigint").alias("flags"))


def story_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of ward stories: eight hex digits over the ward's figures."""
    return table(spark, sf_dir, "nation").select("n_nationkey", cache_key(F.col("n_nationkey"), F.col("n_name")).alias("key"))


def type_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanity counts: events per type with and without a value, and users."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(count_where(F.col("value").isNotNull()).alias("valued"), count_where(F.col("value").isNull()).alias("bare"), F.countDistinct("user_id").alias("users"))


QUERIES = {
    f.__name__: f
    for f in (
        customer_filters, stats_by_constituency, budget_summary, ward_bundle, latest_three_years, canonical_regions, contact_updates, spend_by_ward, editorial_feed, work_queue,
        point_jurisdictions, indicator_bands, vendor_labels, story_keys, type_coverage,
    )
}
ORACLES = {
    "customer_filters": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 9000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name ILIKE '%#0000%' AND lower(c_name) LIKE 'customer%' AND c_nationkey <> 3",
    "stats_by_constituency": """
WITH w AS (SELECT c_nationkey, count(*) AS people, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS balance FROM customer GROUP BY 1)
SELECT n_regionkey, count(*) AS ward_count, CAST(sum(people) AS BIGINT) AS people, CAST(sum(balance) AS DOUBLE) AS balance, round(avg(people), 6) AS people_per_ward FROM nation LEFT JOIN w ON n_nationkey = c_nationkey GROUP BY 1""",
    "budget_summary": """
WITH s AS (SELECT year(l_shipdate) AS fy, p_type AS department, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT fy, department, round(CAST(amount AS DOUBLE) / 1e7, 4) AS amount_cr, CAST(floor(CAST(amount AS DOUBLE) * 100 / CAST(sum(amount) OVER (PARTITION BY fy) AS DOUBLE) + 0.5) AS BIGINT) AS share_pct FROM s""",
    "ward_bundle": """
WITH p AS (SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders JOIN customer ON o_custkey = c_custkey),
o AS (SELECT c_nationkey, count(*) AS order_count, '[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 3) || ']' AS orders FROM p GROUP BY 1),
v AS (SELECT s_nationkey, '[' || string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) || ']' AS vendors FROM supplier GROUP BY 1)
SELECT n_nationkey, order_count, orders, coalesce(vendors, '[]') AS vendors FROM nation LEFT JOIN o ON c_nationkey = n_nationkey LEFT JOIN v ON s_nationkey = n_nationkey""",
    "latest_three_years": """
WITH y AS (SELECT c_nationkey, year(o_orderdate) AS fy, count(*) AS n, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY year(o_orderdate) DESC) AS r FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_nationkey, fy, n FROM y WHERE r <= 3""",
    "canonical_regions": "SELECT r_regionkey, CASE lower(trim(r_name)) WHEN 'europe' THEN 'EU' WHEN 'asia' THEN 'AS' WHEN 'middle east' THEN 'ME' ELSE r_name END AS r_name FROM region",
    "contact_updates": "SELECT n_name AS name, CASE WHEN lower(n_name) LIKE 'nation^_2%' ESCAPE '^' THEN '222' WHEN contains(lower(n_name), 'tion_11') THEN '111' END AS phone, n_nationkey AS ward_no FROM nation",
    "spend_by_ward": "SELECT n_nationkey AS ward_no, n_name AS ward_name, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2",
    "editorial_feed": "SELECT event_id, event_type = 'signup' AS is_editorial FROM events ORDER BY 2 DESC, ts DESC, event_id LIMIT 20",
    "work_queue": "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 20",
    "point_jurisdictions": """
WITH p AS (SELECT user_id % 10 + 0.5::DOUBLE AS lon, minute(ts) / 6.0::DOUBLE + 0.05::DOUBLE AS lat FROM events)
SELECT 'ward' || (CAST(floor(lat / 2) AS INT) * 5 + CAST(floor(lon / 2) AS INT)) AS ward, 'zone' || (CAST(floor(lat / 5) AS INT) * 2 + CAST(floor(lon / 5) AS INT)) AS zone, count(*) AS n FROM p GROUP BY 1, 2""",
    "indicator_bands": """
WITH b AS (SELECT CASE WHEN p_size <= 35 THEN 'good' WHEN p_size <= 60 THEN 'moderate' ELSE 'poor' END AS pm25, CASE WHEN p_size * 2 <= 60 THEN 'good' WHEN p_size * 2 <= 100 THEN 'moderate' ELSE 'poor' END AS pm10,
  CASE WHEN p_size / 5.0::DOUBLE >= 6 THEN 'good' WHEN p_size / 5.0::DOUBLE >= 4 THEN 'moderate' ELSE 'poor' END AS oxygen, CASE WHEN p_size / 5.0::DOUBLE <= 3 THEN 'good' WHEN p_size / 5.0::DOUBLE <= 6 THEN 'moderate' ELSE 'poor' END AS bod,
  CASE WHEN p_retailprice * 3 <= 500 THEN 'good' WHEN p_retailprice * 3 <= 5000 THEN 'moderate' ELSE 'poor' END AS coliform, CASE WHEN p_type[1] IN ('A', 'B') THEN 'good' WHEN p_type[1] = 'C' THEN 'moderate' ELSE 'poor' END AS water,
  CASE WHEN p_size / 2.0::DOUBLE > 15 THEN 'high' WHEN p_size / 2.0::DOUBLE > 10 THEN 'raised' ELSE 'normal' END AS deduction FROM part)
SELECT *, count(*) AS n FROM b GROUP BY ALL""",
    "vendor_labels": """
SELECT s_suppkey, s_name || CASE WHEN s_acctbal < 0 THEN ' (owing)' ELSE '' END || CASE WHEN s_nationkey = 1 THEN ', 1 criminal case' WHEN s_nationkey > 0 THEN ', ' || s_nationkey || ' criminal cases' ELSE '' END AS label,
       CASE WHEN s_suppkey >= 100 THEN 'Rs ' || printf('%.2f', s_suppkey / 100.0::DOUBLE) || ' Cr' ELSE 'Rs ' || printf('%.2f', CAST(s_suppkey AS DOUBLE)) || ' L' END AS money,
       CASE WHEN contains(lower(s_name), '#00000000') OR contains(s_name, '007') THEN 1 ELSE 0 END AS flags FROM supplier""",
    "story_keys": "SELECT n_nationkey, substr(md5('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}'), 1, 8) AS key FROM nation",
    "type_coverage": "SELECT event_type, count(value) AS valued, count(*) - count(value) AS bare, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
}
