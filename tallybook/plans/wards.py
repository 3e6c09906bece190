"""Wards (nations) and their constituencies (regions): report cards, scores, headlines, exports, comparisons."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import bands
from tallybook.functions.text import percent, shortened, slug
from tallybook.operators.export import csv_lines, json_envelope, markdown_pages
from tallybook.operators.joins import compare_by_name, left_lookup, star
from tallybook.operators.ranking import clamped, latest, search, top_per_group
from tallybook.operators.ranking import metric_ranks as ranks_of_metrics
from tallybook.operators.rollup import against_average, category_pivot, count_where, listing, nested_years, share_of_total, status_pivot, unanswered
from tallybook.operators.scoring import accountability_score, share_stat, share_text, ward_headline
from tallybook.session import table, written

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ward with its indicators; the spine is every nation."""
    wards = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    spine = wards.select(F.col("n_nationkey").alias("ward_no"), F.col("n_name").alias("ward_name"), F.col("r_name").alias("constituency"))
    one_decimal = lambda c: F.floor(c * 10 + 0.5) / 10
    orders = _orders(spark, sf_dir).groupBy(F.col("c_nationkey").alias("ward_no")).agg(
        F.count("*").alias("orders"),
        one_decimal(F.lit(100.0) * F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("attendance"),
        one_decimal(F.lit(100.0) * F.count_if(F.col("o_orderpriority") == "1-URGENT") / F.count("*")).alias("fund_use"),
        count_where((F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") < 20000)).alias("meetings"),
    )
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("ward_no")).agg(
        F.count("*").alias("vendors"), count_where(F.col("s_acctbal") < 0).alias("cases"), count_where(F.col("s_acctbal") < 500).alias("flagged"), count_where(F.col("s_acctbal") > 8000).alias("signals")
    )
    return star(spine, [(orders, "ward_no"), (suppliers, "ward_no")])


CARDS_SQL = """
o AS (
  SELECT c_nationkey AS ward_no, count(*) AS orders,
         floor(100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) * 10 + 0.5) / 10 AS attendance,
         floor(100.0::DOUBLE * count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*) * 10 + 0.5) / 10 AS fund_use,
         count(*) FILTER (WHERE o_orderpriority = '5-LOW' AND o_totalprice < 20000) AS meetings
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
s AS (
  SELECT s_nationkey AS ward_no, count(*) AS vendors, count(*) FILTER (WHERE s_acctbal < 0) AS cases,
         count(*) FILTER (WHERE s_acctbal < 500) AS flagged, count(*) FILTER (WHERE s_acctbal > 8000) AS signals
  FROM supplier GROUP BY 1),
cards AS (
  SELECT n_nationkey AS ward_no, n_name AS ward_name, r_name AS constituency, orders, attendance, fund_use, meetings, vendors, cases, flagged, signals
  FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON o.ward_no = n_nationkey LEFT JOIN s ON s.ward_no = n_nationkey)"""


def report_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of every ward with their bands."""
    return _cards(spark, sf_dir).select(
        "ward_no", "attendance", "fund_use", "cases", bands.attendance_band(F.col("attendance")).alias("attendance_band"), bands.fund_use_band(F.col("fund_use")).alias("fund_band"), bands.committee_band(F.col("meetings")).alias("committee_band")
    )


def accountability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and band of every ward; null with fewer than two dimensions."""
    c = {n: F.col(n) for n in ("attendance", "fund_use", "cases", "flagged", "vendors")}
    scored = _cards(spark, sf_dir).withColumn("score", accountability_score(c["attendance"], c["fund_use"], c["cases"], c["flagged"], F.coalesce(c["vendors"], F.lit(0))))
    return scored.select("ward_no", "ward_name", "score", bands.score_band(F.col("score")).alias("score_band"))


def ward_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline of highest priority, the share card's figure and its text."""
    c = {n: F.col(n) for n in ("attendance", "fund_use", "cases", "flagged", "meetings", "signals")}
    picked = _cards(spark, sf_dir).withColumn("h", ward_headline(c["flagged"], c["cases"], c["fund_use"], c["attendance"], c["meetings"], c["signals"]))
    stat = share_stat(c["fund_use"], c["cases"], c["attendance"])
    text = share_text(F.col("ward_name"), F.lit(None).cast("string"), c["fund_use"], c["cases"], c["attendance"])
    return picked.select("ward_no", F.col("h.priority").cast("int").alias("priority"), F.col("h.severity").alias("severity"), F.col("h.text").alias("headline"), stat.alias("share_stat"), text.alias("share_text"))


METRICS = ["attendance", "fund_use", "cases", "vendors", "signals", "meetings", "orders", "flagged", "people", "buildings", "workshops", "in_debt"]


def metric_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top and bottom five wards of each of twelve metrics: top-k reports."""
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("ward_no")).agg(
        F.count("*").alias("people"), count_where(F.col("c_mktsegment") == "BUILDING").alias("buildings"), count_where(F.col("c_mktsegment") == "MACHINERY").alias("workshops"), count_where(F.col("c_acctbal") < 0).alias("in_debt"),
    )
    return ranks_of_metrics(written(star(_cards(spark, sf_dir), [(people, "ward_no")])), ["ward_no", "ward_name"], METRICS)


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each ward by status, with the close rate and its band."""
    pivoted = status_pivot(_orders(spark, sf_dir), ["c_nationkey"], "o_orderstatus", {"closed": "F", "in_progress": "P", "registered": "O"})
    return pivoted.withColumn("close_rate", percent(F.col("closed"), F.col("total"))).withColumn("band", bands.close_rate_band(F.col("close_rate")))


def segment_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each ward by segment, one column each."""
    return category_pivot(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", SEGMENTS)


def city_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over all customers: count, wards, classes of balance."""
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").agg(
        F.count("*").alias("bodies"), F.countDistinct("c_nationkey").alias("wards"), count_where(balance >= 5000).alias("good"),
        count_where((balance >= 0) & (balance < 5000)).alias("fair"), count_where(balance < 0).alias("poor"), F.count_distinct(F.when(balance < 0, F.col("c_nationkey"))).alias("poor_wards"),
    )


def star_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide export: every ward with every indicator, as CSV lines."""
    cards = _cards(spark, sf_dir)
    order_years = latest(_orders(spark, sf_dir).groupBy("c_nationkey", F.year("o_orderdate").alias("fy")).agg(F.count("*").alias("latest_orders")), ["c_nationkey"], "fy").withColumnRenamed("c_nationkey", "ward_no")
    wide = star(cards, [(order_years, "ward_no")])
    return csv_lines(wide.select("ward_no", "ward_name", "constituency", "orders", "vendors", "cases", "flagged", "fy", "latest_orders")).withColumnRenamed("line", "csv_line")


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wards with the card of their constituency, joined by lower-case name; the last of repeated cards counts."""
    regions = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cards = regions.select(F.upper("r_name").alias("constituency"), F.col("n_name").alias("member"), F.col("n_nationkey").alias("seat"))
    wards = regions.select(F.col("n_nationkey").alias("ward_no"), F.lower("r_name").alias("area"))
    return left_lookup(wards, cards, {"area": "constituency"}, ["seat"])


def compare_wards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked names against wards, with whether each was found."""
    names = spark.sql("SELECT * FROM VALUES ('nation_1'), ('NATION_7'), ('nowhere') AS asked(asked)")
    return compare_by_name(names, _cards(spark, sf_dir), "ward_name", "ward_no").select("asked", "found", "ward_no", "ward_name", "orders", "vendors")


def ward_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search box for `on_1`: first eight wards by number (a top-k report)."""
    return search(_cards(spark, sf_dir), "ward_name", "ward_no", "on_1").select("ward_no", "ward_name")


def wards_by_constituency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(_cards(spark, sf_dir), "constituency", "ward_no").withColumn("members", F.array_join("members", ","))


def order_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each priority's share of its ward's order value."""
    sums = _orders(spark, sf_dir).groupBy("c_nationkey", "o_orderpriority").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))
    return share_of_total(sums, "amount", "c_nationkey").withColumn("amount", F.col("amount").cast("double"))


def against_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each ward against the city's average."""
    return against_average(_cards(spark, sf_dir).select("ward_no", "orders"), "orders").withColumn("city_average", F.round("city_average", 6))


def tax_by_constituency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per constituency its years with sums and counts, as JSON."""
    joined = _orders(spark, sf_dir).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("fy", F.year("o_orderdate"))
    nested = nested_years(joined, "n_regionkey", "fy", applications=F.count("*"), wards=F.countDistinct("c_nationkey"))
    return nested.select("n_regionkey", F.to_json("years").alias("years"))


def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that a ward has no customer above 9000 in: the catalogue less what is answered."""
    wards = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ward_no"))
    questions = spark.createDataFrame([(s,) for s in SEGMENTS], "question string")
    answered = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("ward_no"), F.col("c_mktsegment").alias("question"))
    return unanswered(wards, questions, answered, ["ward_no", "question"])


def api_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON envelope of a page of wards: one row, at most the API's page size."""
    return json_envelope(_cards(spark, sf_dir).select("ward_no", "ward_name").orderBy("ward_no"), "tallybook", "CC BY 4.0", clamped(None)).select(F.get_json_object("body", "$.count").cast("bigint").alias("n"), F.get_json_object("body", "$.license").alias("license"), F.get_json_object("body", "$.data").alias("data"))


def ward_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown page per ward with its five largest orders."""
    top = top_per_group(_orders(spark, sf_dir), ["c_nationkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)
    named = top.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    pages = markdown_pages(named, "c_nationkey", "n_name", ["o_orderkey", "o_orderpriority"])
    return pages.select(F.col("c_nationkey").alias("ward_no"), "page")


def ward_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("Ward: "), F.col("n_name"), F.lit(" — No. "), F.col("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", slug(label).alias("slug"), shortened(label, 20).alias("short"))


SCORE_SQL = """
scored AS (
  SELECT *, CASE WHEN (attendance IS NOT NULL)::INT + (fund_use IS NOT NULL)::INT + (cases IS NOT NULL)::INT + (coalesce(vendors, 0) > 0)::INT >= 2 THEN
    CAST(floor((CASE WHEN attendance IS NULL THEN 0 ELSE least(attendance, 100) * 2 END + CASE WHEN fund_use IS NULL THEN 0 ELSE least(fund_use, 100) * 2 END
      + CASE WHEN cases IS NULL THEN 0 ELSE greatest(0, 100 - 20 * cases) * 1.5::DOUBLE END + CASE WHEN coalesce(vendors, 0) > 0 THEN greatest(0, 100 - 40 * flagged) * 1.5::DOUBLE ELSE 0 END)
      / (CASE WHEN attendance IS NULL THEN 0 ELSE 2 END + CASE WHEN fund_use IS NULL THEN 0 ELSE 2 END + CASE WHEN cases IS NULL THEN 0 ELSE 1.5::DOUBLE END + CASE WHEN coalesce(vendors, 0) > 0 THEN 1.5::DOUBLE ELSE 0 END) + 0.5) AS INT) END AS score
  FROM cards)"""

QUERIES = {
    f.__name__: f
    for f in (
        report_cards, accountability_scores, ward_headlines, metric_ranks, status_counts, segment_pivot, city_totals, star_export, representatives, compare_wards,
        ward_search, wards_by_constituency, order_shares, against_city, tax_by_constituency, open_questions, api_page, ward_pages, ward_slugs,
    )
}
ORACLES = {
    "report_cards": f"""
WITH {CARDS_SQL} SELECT ward_no, attendance, fund_use, cases,
  CASE WHEN attendance >= 85 THEN 'good' WHEN attendance >= 75 THEN 'fair' WHEN attendance IS NOT NULL THEN 'poor' END AS attendance_band,
  CASE WHEN fund_use >= 75 THEN 'good' WHEN fund_use >= 50 THEN 'fair' WHEN fund_use IS NOT NULL THEN 'poor' END AS fund_band,
  CASE WHEN meetings = 0 THEN 'never met' WHEN meetings < 10 THEN 'rarely' WHEN meetings < 25 THEN 'sometimes' WHEN meetings IS NOT NULL THEN 'regularly' END AS committee_band FROM cards""",
    "accountability_scores": f"""
WITH {CARDS_SQL}, {SCORE_SQL} SELECT ward_no, ward_name, score,
  CASE WHEN score >= 70 THEN 'green' WHEN score >= 50 THEN 'yellow' WHEN score >= 30 THEN 'orange' WHEN score IS NOT NULL THEN 'red' END AS score_band FROM scored""",
    "ward_headlines": f"""
WITH {CARDS_SQL}, p AS (
  SELECT *, CASE WHEN flagged > 0 THEN 100 WHEN cases > 0 THEN 90 WHEN fund_use = 0 THEN 85 WHEN attendance < 40 THEN 80 WHEN meetings = 0 THEN 75 WHEN signals = 0 THEN 60 WHEN fund_use > 0 AND fund_use < 30 THEN 55 END AS priority FROM cards)
SELECT ward_no, priority, CASE WHEN priority >= 75 THEN 'red' WHEN priority IS NOT NULL THEN 'yellow' END AS severity,
  CASE priority WHEN 100 THEN flagged || CASE WHEN flagged = 1 THEN ' flagged contractor' ELSE ' flagged contractors' END || ' active in this ward'
    WHEN 90 THEN 'MLA has ' || cases || CASE WHEN cases = 1 THEN ' criminal case' ELSE ' criminal cases' END
    WHEN 85 THEN 'MLA has spent 0% of development funds' WHEN 80 THEN 'MLA attended only ' || attendance || '% of assembly sessions'
    WHEN 75 THEN 'Ward committee has never met' WHEN 60 THEN 'This ward has zero traffic signals'
    WHEN 55 THEN 'Only ' || fund_use || '% of MLA development funds used' END AS headline,
  CASE WHEN fund_use = 0 THEN 'fund_use_zero' WHEN cases >= 3 THEN 'criminal_cases' WHEN attendance < 65 THEN 'attendance' WHEN fund_use IS NOT NULL THEN 'fund_use' END AS share_stat,
  CASE WHEN fund_use = 0 THEN 'My MLA in ' || ward_name || ' has spent 0% of the development fund'
    WHEN cases >= 3 THEN 'My MLA in ' || ward_name || ' has ' || cases || ' criminal cases'
    WHEN attendance < 60 THEN 'My MLA in ' || ward_name || ' attended ' || attendance || '% of sessions'
    ELSE 'See who is accountable in ' || ward_name END AS share_text FROM p""",
    "metric_ranks": f"""
WITH {CARDS_SQL}, p AS (SELECT c_nationkey AS ward_no, count(*) AS people, count(*) FILTER (c_mktsegment = 'BUILDING') AS buildings, count(*) FILTER (c_mktsegment = 'MACHINERY') AS workshops, count(*) FILTER (c_acctbal < 0) AS in_debt FROM customer GROUP BY 1),
wide AS (SELECT * FROM cards LEFT JOIN p USING (ward_no)),
long AS ({" UNION ALL ".join(f"SELECT ward_no, ward_name, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM wide" for m in METRICS)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, ward_no) AS t, row_number() OVER (PARTITION BY metric ORDER BY value, ward_no) AS b FROM long WHERE value IS NOT NULL)
SELECT ward_no, ward_name, value, metric, 'top' AS side FROM ranked WHERE t <= 5 UNION ALL SELECT ward_no, ward_name, value, metric, 'bottom' FROM ranked WHERE b <= 5""",
    "status_counts": """
WITH p AS (
  SELECT c_nationkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed, count(*) FILTER (WHERE o_orderstatus = 'P') AS in_progress, count(*) FILTER (WHERE o_orderstatus = 'O') AS registered
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
r AS (SELECT *, CAST(floor(closed * 100.0::DOUBLE / total + 0.5) AS BIGINT) AS close_rate FROM p)
SELECT *, CASE WHEN close_rate >= 90 THEN 'good' WHEN close_rate >= 70 THEN 'fair' ELSE 'poor' END AS band FROM r""",
    "segment_pivot": "SELECT c_nationkey, " + ", ".join(f"count(*) FILTER (WHERE c_mktsegment = '{s}') AS \"{s}\"" for s in SEGMENTS) + " FROM customer GROUP BY 1",
    "city_totals": """
SELECT count(*) AS bodies, count(DISTINCT c_nationkey) AS wards, count(*) FILTER (WHERE c_acctbal >= 5000) AS good, count(*) FILTER (WHERE c_acctbal >= 0 AND c_acctbal < 5000) AS fair,
       count(*) FILTER (WHERE c_acctbal < 0) AS poor, count(DISTINCT CASE WHEN c_acctbal < 0 THEN c_nationkey END) AS poor_wards FROM customer""",
    "star_export": f"""
WITH {CARDS_SQL}, y AS (SELECT c_nationkey, year(o_orderdate) AS fy, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY year(o_orderdate) DESC) AS rn FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT coalesce(CAST(ward_no AS VARCHAR), '') || ',' || ward_name || ',' || constituency || ',' || coalesce(CAST(orders AS VARCHAR), '') || ',' || coalesce(CAST(vendors AS VARCHAR), '') || ',' || coalesce(CAST(cases AS VARCHAR), '')
  || ',' || coalesce(CAST(flagged AS VARCHAR), '') || ',' || coalesce(CAST(fy AS VARCHAR), '') || ',' || coalesce(CAST(n AS VARCHAR), '') AS csv_line FROM cards LEFT JOIN y ON c_nationkey = ward_no AND rn = 1""",
    "representatives": """
WITH c AS (SELECT n_regionkey, n_name AS member, n_nationkey AS seat, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS rn FROM nation)
SELECT n.n_nationkey AS ward_no, lower(r_name) AS area, member, seat FROM nation n JOIN region ON n_regionkey = r_regionkey LEFT JOIN c ON c.n_regionkey = n.n_regionkey AND rn = 1""",
    "compare_wards": f"""
WITH {CARDS_SQL}, asked(asked) AS (VALUES ('nation_1'), ('NATION_7'), ('nowhere')),
hits AS (SELECT asked, cards.*, row_number() OVER (PARTITION BY asked ORDER BY ward_no NULLS LAST) AS rn FROM asked LEFT JOIN cards ON contains(lower(ward_name), lower(asked)))
SELECT asked, ward_no IS NOT NULL AS found, ward_no, ward_name, orders, vendors FROM hits WHERE rn = 1""",
    "ward_search": "SELECT n_nationkey AS ward_no, n_name AS ward_name FROM nation WHERE contains(lower(n_name), 'on_1') OR CAST(n_nationkey AS VARCHAR) = 'on_1' ORDER BY 1 LIMIT 8",
    "wards_by_constituency": "SELECT r_name AS grouped, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "order_shares": """
WITH s AS (SELECT c_nationkey, o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_nationkey, o_orderpriority, CAST(amount AS DOUBLE) AS amount, CAST(floor(CAST(amount AS DOUBLE) * 100 / CAST(sum(amount) OVER (PARTITION BY c_nationkey) AS DOUBLE) + 0.5) AS BIGINT) AS share_pct FROM s""",
    "against_city": f"WITH {CARDS_SQL} SELECT ward_no, orders, round((SELECT avg(orders) FROM cards), 6) AS city_average, orders > (SELECT avg(orders) FROM cards) AS above FROM cards",
    "tax_by_constituency": """
WITH y AS (SELECT n_regionkey, year(o_orderdate) AS fy, count(*) AS applications, count(DISTINCT c_nationkey) AS wards FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_regionkey, '[' || string_agg('{"fy":' || fy || ',"applications":' || applications || ',"wards":' || wards || '}', ',' ORDER BY fy) || ']' AS years FROM y GROUP BY 1""",
    "open_questions": "SELECT n_nationkey AS ward_no, question FROM nation CROSS JOIN (VALUES " + ", ".join(f"('{s}')" for s in SEGMENTS) + ") q(question) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = question AND c_acctbal > 9000)",
    "api_page": """SELECT count(*) AS n, 'CC BY 4.0' AS license, '[' || string_agg('{"ward_no":' || n_nationkey || ',"ward_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS data FROM nation""",
    "ward_pages": r"""
WITH t AS (SELECT c_nationkey, n_name, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT c_nationkey AS ward_no, '# ' || min(n_name) || chr(10) || chr(10) || '| o_orderkey | o_orderpriority |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderpriority || ' |', chr(10) ORDER BY rank) || chr(10) AS page FROM t WHERE rank <= 5 GROUP BY 1""",
    "ward_slugs": """
SELECT n_nationkey, 'ward-nation-' || n_nationkey || '-no-' || n_nationkey AS slug,
       CASE WHEN length('Ward: ' || n_name || ' — No. ' || n_nationkey) > 20 THEN substr('Ward: ' || n_name || ' — No. ' || n_nationkey, 1, 17) || '...' ELSE 'Ward: ' || n_name || ' — No. ' || n_nationkey END AS short FROM nation""",
}
