"""Vendors (suppliers) and their work orders (line items): profiles, flags, leaderboards, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.text import coded_name, fiscal_year_of_code, trailing_phone, vendor_name
from tallybook.operators.dedup import keep_first, keep_last, keep_max
from tallybook.operators.entity import alias_matches, flags, fuzzy_matches, refreshed_profiles, vendor_profiles, work_facts
from tallybook.operators.ranking import leaderboards, optional_predicates, ranked, top_per_group
from tallybook.operators.rollup import city_summary, stage_distribution, totals_with_all, yearly_with_top
from tallybook.session import table, written

GOVERNMENT_PATTERNS = ("%00001", "%00007", "%00002 PVT LTD")
FEWER_PATTERNS = GOVERNMENT_PATTERNS[:2]


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_facts(*(table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "customer")))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendor_profiles(_facts(spark, sf_dir), GOVERNMENT_PATTERNS)


def vendor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vendor with totals in lakh, wards served, first and last year."""
    return _profiles(spark, sf_dir).withColumns({c: F.array_join(c, ",") for c in ("wards", "aliases")})


def vendor_profile_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the orders before 1996, refreshed with those of all orders but 1995's, under fewer government patterns."""
    facts = _facts(spark, sf_dir)
    merged = refreshed_profiles(vendor_profiles(facts.where("fy < '1996'"), GOVERNMENT_PATTERNS), facts.where("fy <> '1995'"), FEWER_PATTERNS)
    return merged.withColumns({c: F.array_join(c, ",") for c in ("wards", "aliases")})


def ward_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many flagged vendors each ward has, and their value."""
    served = _flagged_profiles(spark, sf_dir).select(F.explode("wards").alias("ward_no"), (F.size("blacklist_flags") > 0).alias("flagged"), F.col("total_value_lakh").cast("decimal(18,2)").alias("value"))
    value = F.coalesce(F.sum(F.when(F.col("flagged"), F.col("value"))), F.lit(0)).cast("double")
    return served.groupBy("ward_no").agg(F.count_if("flagged").cast("bigint").alias("flagged"), value.alias("flagged_lakh"), F.count("*").alias("vendors"))


def vendor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors under optional predicates: each is applied only where its parameter is given."""
    profiles = _flagged_profiles(spark, sf_dir)
    asks = [{"ward": "5", "flagged": "true"}, {"ward": "7", "flagged": None}, {"ward": None, "flagged": "true"}, {"ward": None, "flagged": None}]
    found = [optional_predicates(profiles, {"ward": lambda v: F.array_contains("wards", int(v)), "flagged": lambda v: F.size("blacklist_flags") > 0 if v == "true" else F.lit(True)}, ask).agg(F.count("*").alias("n"), F.min("entity_id").alias("first")).withColumn("ask", F.lit(k)) for k, ask in enumerate(asks)]
    return reduce(DataFrame.unionByName, found)


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    owing = table(spark, sf_dir, "supplier").where("s_acctbal < 0")
    nations = table(spark, sf_dir, "nation")
    return owing.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.upper("s_name").alias("listed_name"), F.col("n_name").alias("source"))


def _flagged_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = written(_profiles(spark, sf_dir))
    matched = flags(alias_matches(profiles, _listed(spark, sf_dir)))
    return written(profiles.join(matched, "entity_id", "left").withColumn("blacklist_flags", F.coalesce("blacklist_flags", F.array().cast("array<string>"))))


def vendor_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged vendors with the sources that list them."""
    flagged = _flagged_profiles(spark, sf_dir).where(F.size("blacklist_flags") > 0)
    return flagged.select("entity_id", "total_value_lakh", F.array_join("blacklist_flags", ",").alias("blacklist_flags"))


def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names within distance 0.4 of the listed ones."""
    parts = table(spark, sf_dir, "part").withColumn("name", F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    names = parts.select(F.col("p_partkey").alias("entity_id"), "name")
    listed = parts.where("p_size = 1").select(F.col("name").alias("listed_name"), F.col("p_brand").alias("source")).distinct()
    return fuzzy_matches(names, listed).select("entity_id", "listed_name", "source", F.round("distance", 6).alias("distance"))


def vendor_leaderboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of every leaderboard: top-k reports."""
    return leaderboards(_flagged_profiles(spark, sf_dir)).select("board", "entity_id", "total_value_lakh", "total_contracts", "avg_deduction_pct", "ward_count")


def vendors_of_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors that serve wards 3 and have contracts in more than one (array predicates)."""
    return _profiles(spark, sf_dir).where(F.array_contains("wards", 3) & (F.size("wards") > 1)).select("entity_id", "total_contracts", "ward_count")


def ward_vendor_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ward's vendors, the largest first (profile wards unnested)."""
    exploded = _profiles(spark, sf_dir).select(F.explode("wards").alias("ward_no"), "entity_id", "total_value_lakh")
    return ranked(exploded, ["ward_no"], [F.desc("total_value_lakh"), F.asc("entity_id")], "position")


def _orders_of_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.withColumn("sanctioned", F.col("l_extendedprice").cast("decimal(18,2)"))


def ward_top10_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten largest work orders of each ward."""
    order = [F.desc_nulls_last("sanctioned"), *(F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"))]
    top = top_per_group(_orders_of_work(spark, sf_dir), ["c_nationkey"], order, 10)
    return top.select(F.col("c_nationkey").alias("ward_no"), "rank", "l_orderkey", "l_linenumber", F.col("sanctioned").cast("double").alias("sanctioned"))


def year_rollup_top_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per ward and year: lines, new and other ones, fees, most frequent part type."""
    lines, parts, suppliers = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("year", F.year("l_shipdate"))
    rolled = yearly_with_top(joined, ["s_nationkey", "year"], F.col("l_returnflag") == "N", F.col("l_extendedprice").cast("decimal(18,2)"), "p_type")
    return rolled.withColumn("fees", F.col("fees").cast("double"))


def rollup_with_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values by ward and year, with an ALL row per ward."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("fy", F.year("o_orderdate"))
    return totals_with_all(orders, "c_nationkey", "fy", F.col("o_totalprice").cast("decimal(18,2)")).withColumn("total", F.col("total").cast("double"))


def bill_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by return flag and status: a top-k report."""
    lines = table(spark, sf_dir, "lineitem").withColumn("stage_text", F.concat("l_returnflag", "l_linestatus"))
    return stage_distribution(lines, "stage_text", F.col("l_extendedprice").cast("decimal(18,2)")).withColumn("amount", F.col("amount").cast("double"))


def works_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about all work orders; `O` lines are the live ones."""
    lines = table(spark, sf_dir, "lineitem").withColumn("fy", F.year("l_shipdate").cast("string"))
    return city_summary(lines, "l_linestatus", "O", F.col("l_extendedprice").cast("decimal(18,2)"), "fy", "l_suppkey", "l_returnflag").withColumn("amount", F.col("amount").cast("double"))


TOTAL_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
SHOWN = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], TOTAL_ORDER).select(SHOWN)


def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_last(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], TOTAL_ORDER).select(SHOWN)


def dedup_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_max(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_quantity", TOTAL_ORDER).select(*SHOWN, "l_quantity")


def vendor_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor strings as portals print them, taken apart again."""
    raw = F.concat(F.lit("123456 M/s "), F.col("s_name"), F.lit(".,"), F.lpad(F.col("s_suppkey").cast("string"), 10, "9"))
    coded = coded_name(F.concat(F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.lit(" "), F.col("s_name")))
    code = F.concat(F.lit("001-"), F.lpad((F.col("s_nationkey") + 10).cast("string"), 2, "0"), F.lit("-000006"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", vendor_name(raw).alias("name"), trailing_phone(raw).alias("phone"), coded["code"].alias("code"), fiscal_year_of_code(code).alias("fy"))


FACTS_SQL = """
facts AS (
  SELECT CASE l_linenumber % 4 WHEN 0 THEN upper(s_name) WHEN 1 THEN s_name || ' Pvt Ltd' ELSE s_name END AS vendor_name,
         CASE WHEN l_suppkey % 3 <> 0 THEN lpad(CAST(l_suppkey AS VARCHAR), 10, '9') END AS phone,
         c_nationkey AS ward_no, CAST(year(o_orderdate) AS VARCHAR) AS fy,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS sanctioned,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS deduction
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)"""


def profiles_sql(name: str, facts: str, patterns: tuple[str, ...]) -> str:
    """Profiles of a table of facts, the modal name by counting."""
    govt = " OR ".join(f"upper(vendor_name) LIKE '{p}'" for p in patterns)
    return f"""
{name}_keyed AS (SELECT *, CASE WHEN phone IS NULL THEN 'nm_' || lower(trim(vendor_name)) ELSE 'ph_' || phone END AS entity_id FROM {facts}),
{name}_names AS (SELECT entity_id, vendor_name, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, vendor_name) AS rn FROM {name}_keyed GROUP BY entity_id, vendor_name),
{name} AS (
  SELECT entity_id, max(phone) AS phone, max((SELECT n.vendor_name FROM {name}_names n WHERE n.entity_id = k.entity_id AND rn = 1)) AS canonical_name,
         string_agg(DISTINCT vendor_name, ',' ORDER BY vendor_name) AS aliases, count(*) AS total_contracts,
         round(CAST(sum(sanctioned) AS DOUBLE) / 1e5, 2) AS total_value_lakh,
         round(CAST(sum(CAST(sanctioned - deduction AS DECIMAL(18,4))) AS DOUBLE) / 1e5, 2) AS total_paid_lakh,
         round(CAST(sum(deduction) AS DOUBLE) / 1e5, 2) AS total_deduction_lakh,
         CASE WHEN sum(sanctioned) > 0 THEN round(100 * CAST(sum(deduction) AS DOUBLE) / CAST(sum(sanctioned) AS DOUBLE), 2) ELSE 0.0 END AS avg_deduction_pct,
         count(DISTINCT ward_no) AS ward_count,
         array_to_string(list_sort(list(DISTINCT ward_no)), ',') AS wards,
         min(fy) AS first_seen, max(fy) AS last_seen, bool_or({govt}) AS is_govt_entity
  FROM {name}_keyed k GROUP BY entity_id)"""


PROFILE_SQL = f"{FACTS_SQL}, {profiles_sql('profiles', 'facts', GOVERNMENT_PATTERNS)}"

FLAGS_SQL = f"""
{PROFILE_SQL},
spelled AS (SELECT entity_id, unnest(string_split(aliases, ',')) AS spelling FROM profiles),
flagged AS (
  SELECT entity_id, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS blacklist_flags
  FROM spelled JOIN supplier ON regexp_replace(upper(spelling), ' PVT LTD$', '') = upper(s_name) AND s_acctbal < 0
  JOIN nation ON s_nationkey = n_nationkey GROUP BY entity_id)"""

KEPT_SQL = """
SELECT {shown} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS rn FROM lineitem) WHERE rn = 1"""

QUERIES = {
    f.__name__: f
    for f in (
        vendor_profile, vendor_profile_variant, vendor_flagged, ward_flagged, vendor_search, fuzzy_names, vendor_leaderboards, vendors_of_ward, ward_vendor_list, ward_top10_orders, year_rollup_top_type,
        rollup_with_all, bill_stages, works_summary, dedup_first, dedup_last, dedup_max, vendor_strings,
    )
}
ORACLES = {
    "vendor_profile": f"WITH {PROFILE_SQL} SELECT * FROM profiles",
    "vendor_profile_variant": f"""
WITH {FACTS_SQL}, early AS (SELECT * FROM facts WHERE fy < '1996'), late AS (SELECT * FROM facts WHERE fy <> '1995'),
{profiles_sql('old', 'early', GOVERNMENT_PATTERNS)}, {profiles_sql('fresh', 'late', FEWER_PATTERNS)}
SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE entity_id NOT IN (SELECT entity_id FROM fresh)""",
    "ward_flagged": f"""
WITH {FLAGS_SQL}, served AS (SELECT DISTINCT entity_id, ward_no FROM profiles_keyed)
SELECT ward_no, count(*) FILTER (WHERE f.entity_id IS NOT NULL) AS flagged, coalesce(CAST(sum(CAST(total_value_lakh AS DECIMAL(18,2))) FILTER (WHERE f.entity_id IS NOT NULL) AS DOUBLE), 0) AS flagged_lakh, count(*) AS vendors
FROM served JOIN profiles USING (entity_id) LEFT JOIN flagged f USING (entity_id) GROUP BY ward_no""",
    "vendor_search": f"""
WITH {FLAGS_SQL}, p AS (SELECT entity_id, string_split(wards, ',') AS ws, f.entity_id IS NOT NULL AS flagged FROM profiles LEFT JOIN flagged f USING (entity_id)),
a(ask, ward, strict) AS (VALUES (0, '5', true), (1, '7', false), (2, NULL, true), (3, NULL, false))
SELECT ask, count(entity_id) AS n, min(entity_id) AS first FROM a LEFT JOIN p ON (ward IS NULL OR list_contains(ws, ward)) AND (flagged OR NOT strict) GROUP BY ask""",
    "vendor_flagged": f"WITH {FLAGS_SQL} SELECT entity_id, total_value_lakh, blacklist_flags FROM profiles JOIN flagged USING (entity_id)",
    "fuzzy_names": """
WITH named AS (SELECT p_partkey AS entity_id, p_size, p_brand AS source, p_name || ' ' || p_type || ' ' || p_brand AS name FROM part),
keyed AS (SELECT *, regexp_replace(upper(name), '[^A-Z0-9 ]', '', 'g') AS k FROM named),
listed AS (SELECT DISTINCT name AS listed_name, source, k AS lk FROM keyed WHERE p_size = 1),
sets AS (
  SELECT entity_id, listed_name, l.source, k, lk,
         list_distinct(list_filter(string_split(k, ' '), lambda t: length(t) > 2)) AS s,
         list_distinct(list_filter(string_split(lk, ' '), lambda t: length(t) > 2)) AS t
  FROM (SELECT entity_id, k FROM keyed) CROSS JOIN listed l),
scored AS (
  SELECT entity_id, listed_name, source,
         CASE WHEN k = lk THEN 0.0 WHEN contains(k, lk) OR contains(lk, k) THEN 0.1
              ELSE 1.0 - CAST(len(list_intersect(s, t)) AS DOUBLE) / len(list_distinct(list_concat(s, t))) END AS distance FROM sets)
SELECT entity_id, listed_name, source, round(CAST(distance AS DOUBLE), 6) AS distance FROM scored WHERE distance <= 0.4""",
    "vendor_leaderboards": f"""
WITH {FLAGS_SQL},
boards AS (
  SELECT 'by_value' AS board, entity_id, total_value_lakh AS measure FROM profiles
  UNION ALL SELECT 'by_contracts', entity_id, total_contracts FROM profiles
  UNION ALL SELECT 'high_deduction', entity_id, avg_deduction_pct FROM profiles WHERE avg_deduction_pct > 15 AND total_contracts >= 3
  UNION ALL SELECT 'multi_ward', entity_id, ward_count FROM profiles WHERE ward_count > 10
  UNION ALL SELECT 'flagged', entity_id, total_value_lakh FROM profiles JOIN flagged USING (entity_id)),
ranked AS (SELECT board, entity_id, row_number() OVER (PARTITION BY board ORDER BY measure DESC, entity_id) AS rn FROM boards)
SELECT board, entity_id, total_value_lakh, total_contracts, avg_deduction_pct, ward_count FROM ranked JOIN profiles USING (entity_id) WHERE rn <= 10""",
    "vendors_of_ward": f"""
WITH {PROFILE_SQL} SELECT entity_id, total_contracts, ward_count FROM profiles
WHERE ward_count > 1 AND list_contains(string_split(wards, ','), '3')""",
    "ward_vendor_list": f"""
WITH {PROFILE_SQL}, served AS (SELECT DISTINCT entity_id, ward_no FROM profiles_keyed)
SELECT ward_no, entity_id, total_value_lakh, row_number() OVER (PARTITION BY ward_no ORDER BY total_value_lakh DESC, entity_id) AS position
FROM served JOIN profiles USING (entity_id)""",
    "ward_top10_orders": """
SELECT ward_no, rank, l_orderkey, l_linenumber, CAST(sanctioned AS DOUBLE) AS sanctioned FROM (
  SELECT c_nationkey AS ward_no, l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS sanctioned,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(l_extendedprice AS DECIMAL(18,2)) DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS rank
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) WHERE rank <= 10""",
    "year_rollup_top_type": """
WITH kinds AS (
  SELECT s_nationkey, year(l_shipdate) AS year, p_type, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS new_n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS fees
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey, year ORDER BY n DESC, p_type) AS rn FROM kinds)
SELECT s_nationkey, year, CAST(sum(n) AS BIGINT) AS total, CAST(sum(new_n) AS BIGINT) AS new, CAST(sum(n) - sum(new_n) AS BIGINT) AS renewed,
       CAST(sum(fees) AS DOUBLE) AS fees, max(p_type) FILTER (WHERE rn = 1) AS top_kind FROM ranked GROUP BY s_nationkey, year""",
    "rollup_with_all": """
WITH o AS (SELECT c_nationkey, CAST(year(o_orderdate) AS VARCHAR) AS fy, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_nationkey, fy, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS entries FROM o GROUP BY c_nationkey, fy
UNION ALL SELECT c_nationkey, 'ALL', CAST(sum(amount) AS DOUBLE), count(*) FROM o GROUP BY c_nationkey""",
    "bill_stages": """
SELECT l_returnflag || l_linestatus AS stage, count(*) AS orders, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "works_summary": """
WITH l AS (SELECT l_linestatus, l_suppkey, l_returnflag, CAST(year(l_shipdate) AS VARCHAR) AS fy, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem)
SELECT count(*) FILTER (WHERE l_linestatus = 'O') AS live, count(*) FILTER (WHERE l_linestatus IS DISTINCT FROM 'O') AS older,
       CAST(sum(amount) AS DOUBLE) AS amount, string_agg(DISTINCT fy, ',' ORDER BY fy) AS years,
       (SELECT l_suppkey FROM l GROUP BY l_suppkey ORDER BY sum(amount) DESC, l_suppkey LIMIT 1) AS top_vendor,
       (SELECT l_returnflag FROM l WHERE l_linestatus = 'O' GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1) AS top_division FROM l""",
    "dedup_first": KEPT_SQL.format(shown=", ".join(SHOWN), order=", ".join(f"{c} ASC NULLS LAST" for c in TOTAL_ORDER)),
    "dedup_last": KEPT_SQL.format(shown=", ".join(SHOWN), order=", ".join(f"{c} DESC NULLS LAST" for c in TOTAL_ORDER)),
    "dedup_max": KEPT_SQL.format(shown=", ".join([*SHOWN, "l_quantity"]), order="coalesce(l_quantity, 0) DESC, " + ", ".join(f"{c} ASC NULLS LAST" for c in TOTAL_ORDER)),
    "vendor_strings": """
SELECT s_suppkey, s_name AS name, lpad(CAST(s_suppkey AS VARCHAR), 10, '9') AS phone, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS code,
       CAST(2000 + s_nationkey + 9 AS VARCHAR) || '-' || lpad(CAST(s_nationkey + 10 AS VARCHAR), 2, '0') AS fy FROM supplier""",
}
