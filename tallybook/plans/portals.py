"""Portals as they are met: catalogues of files, pages of answers, broken cells and feeds, each landed first and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import text
from tallybook.functions.text import lakh_of_rupees, ward_in_title
from tallybook.operators.ranking import ranked
from tallybook.session import shared_folder, table
from tallybook.sources import catalogue, grids, markup
from tallybook.sources.paged import LandedPages, load_pages, stream_pages
from tallybook.streaming.signals import append_available

PARTS = ("plain", "formal", "short")


def _landed_orders(spark: SparkSession, sf_dir: str) -> str:
    """Orders in folders `part=...-ward`, a third each under a header of its own, and one file that no catalogue lists."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key, part = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3
    vendor = F.concat(F.lit("123456 M/s "), "c_name", F.lit(".,"), F.lpad(F.col("c_custkey").cast("string"), 10, "9"))
    amount, net = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), (F.col("o_orderkey") % 1000).cast("string")
    coded = F.concat(F.col("c_nationkey") + 1, F.lit("-24-"), key)
    details = F.concat(F.lit('Drain, "north"\nof '), "c_mktsegment")
    folder, ward = shared_folder(spark), F.col("c_nationkey").cast("string")
    layouts = (
        {"wo num": key, "wodetails": details, "contractor": vendor, "amount": amount, "nett": net, "deduction": F.lit("0")},
        {" Work Order Reference Number": coded, "Amount Paid": net, "Balance": F.lit("12.5"), "Contractor Name & Phone": vendor, "Amount": amount, "Work Order Code & Description": details},
        {"remarks": F.lit("as built"), "WARD": F.concat(F.col("c_nationkey") + 100, F.lit(" East")), "sanctioned_amount": amount, "Description": details, "id": key, "net_paid": F.lit("n/a")},
    )
    for k, (name, columns) in enumerate(zip(PARTS, layouts)):
        rows = joined.where(part == k).select(*(c.alias(h) for h, c in columns.items()), F.concat(F.lit(f"{name}-"), ward).alias("part"))
        rows.repartition("part").write.mode("append").option("header", True).option("escape", '"').option("quoteAll", True).partitionBy("part").csv(folder)
    spark.range(3).select(F.col("id").cast("string").alias("wo num"), F.lit("1").alias("amount"), F.lit("unlisted-1").alias("part")).write.mode("append").option("header", True).partitionBy("part").csv(folder)
    return folder


def _catalogue_of(spark: SparkSession, folder: str) -> str:
    """A catalogue of the landed files (but the unlisted one), of one that never landed, and of one that is no CSV."""
    files = spark.read.text(folder).where("part <> 'unlisted-1'").select("part", F.col("_metadata.file_path").alias("path")).distinct()
    ward = F.regexp_extract("part", r"-(\d+)$", 1)
    name = F.when(F.startswith("part", F.lit("plain")), F.concat(F.lit("Works of ward-0"), ward, F.lit(" 2024"))).when(
        F.startswith("part", F.lit("formal")), F.concat(F.lit("LAD Funds - AC 150 North "), ward, F.lit(" (2013-2018)"))).otherwise(F.concat(F.lit("Zone "), ward, F.lit(" Constituency Works")))
    url = F.concat(F.lit("https://portal.example/dl/part%3D"), "part", F.lit("/"), F.regexp_extract("path", r"([^/]*)$", 1), F.lit("?x=1"))
    listed = files.select(name.alias("name"), url.alias("url"), F.when(ward == "1", " csv ").otherwise("CSV").alias("format"))
    others = spark.createDataFrame([("Ward 900", "https://portal.example/dl/part%3Dgone/x.csv", "CSV"), ("Ward 901", "https://portal.example/dl/map.pdf", "PDF")], "name string, url string, format string")
    whole = listed.unionByName(others).agg(F.to_json(F.struct(F.struct(F.sort_array(F.collect_list(F.struct("name", "url", "format"))).alias("resources")).alias("result"))).alias("value"))  # a row for each file
    path = shared_folder(spark)
    whole.write.text(path)
    return path


def catalogue_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work orders of a catalogue's files under three headers, every cell."""
    folder = _landed_orders(spark, sf_dir)
    orders = catalogue.catalogue_work_orders(spark, _catalogue_of(spark, folder), folder, "2013-2022", multi_line=True, segments=2)
    return orders.withColumns({c: F.col(c).cast("double") for c in ("sanctioned_amount", "net_paid", "deduction")})


def catalogue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read of each listed resource; those that never landed are told."""
    folder = _landed_orders(spark, sf_dir)
    listed = catalogue.resources(spark, _catalogue_of(spark, folder))
    read = catalogue.read_layouts(spark, folder, {"order": ("wo num", "id", "Work Order Reference Number")}, multi_line=True)
    counted = catalogue.with_resource(read, listed, 2).groupBy("resource_ward", "resource_year", "resource_constituency").agg(F.count("order").alias("n"))
    gone = catalogue.missing_files(listed, read, 2).groupBy(F.col("ward_no").alias("resource_ward"), F.col("year").alias("resource_year"), F.col("constituency").alias("resource_constituency")).agg(F.lit(0).cast("bigint").alias("n"))
    return counted.unionByName(gone)


PAGE = 100
STREAMS = ("F", "O", "P")


def _landed_pages(spark: SparkSession, sf_dir: str, before: str | None = None) -> str:
    """Orders as tenders of three agencies, newest first, in pages of a hundred; every eleventh date can't be read."""
    orders = table(spark, sf_dir, "orders")
    if before:
        orders = orders.where(F.col("o_orderdate") < F.lit(before).cast("timestamp_ntz"))
    numbered = ranked(orders.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_custkey"), ["o_orderstatus"], [F.desc("o_orderdate"), F.asc("o_orderkey")])
    tender = F.struct(
        "rank", F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy HH:mm")).alias("publishedDate"),
        F.concat(F.lit("Works in Ward No. "), F.col("o_custkey") % 200).alias("title"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("double").alias("ecv"),
    )
    pages = numbered.groupBy(F.col("o_orderstatus").alias("stream"), F.floor((F.col("rank") - 1) / PAGE).cast("int").alias("page")).agg(F.sort_array(F.collect_list(tender)).alias("data"))
    sizes = numbered.groupBy(F.col("o_orderstatus").alias("stream")).agg(F.count("*").alias("total"))
    folder = shared_folder(spark)
    block = F.floor(F.col("page") / LandedPages.PAGES).cast("int").alias("block")
    answers = pages.join(sizes, "stream").select("stream", block, F.concat_ws("\t", "page", F.to_json(F.struct("total", "data"))).alias("value"))
    answers.repartition("stream", "block").write.partitionBy("stream", "block").text(folder)
    return folder


def _tenders(pages: DataFrame) -> DataFrame:
    told = pages.select("stream", "page", "issued", F.from_json("value", "id bigint, title string, ecv double").alias("t"))
    return told.select("stream", "page", F.col("t.id").alias("tender"), ward_in_title(F.col("t.title")).alias("ward_no"), lakh_of_rupees(F.col("t.ecv")).cast("double").alias("lakh"), F.col("issued").cast("string").alias("issued"))


def tenders_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenders newer than a known date, read page by page up to the first page with a known one, and the whole of one agency."""
    client = LandedPages(_landed_pages(spark, sf_dir))
    new = _tenders(load_pages(spark, client, [*STREAMS, "absent"], since="1998-01-01")).withColumn("run", F.lit("new"))
    whole = _tenders(load_pages(spark, client, list(STREAMS), since="1998-01-01", full=True).where("stream = 'P'")).withColumn("run", F.lit("full"))
    return new.unionByName(whole)


def tenders_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as a stream, read twice: what was published between is all that the second run adds."""
    early, late = LandedPages(_landed_pages(spark, sf_dir, "1997-06-01 00:00:00")), LandedPages(_landed_pages(spark, sf_dir))
    folder = shared_folder(spark)
    for client in (early, late):
        dated = stream_pages(spark, client, list(STREAMS)).where("issued IS NOT NULL")
        append_available(_tenders(dated), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("stream", "tender", "issued")


def grid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payment grid for each customer, some cut off, some errors of the portal, pages or nothing: good rows beside error rows."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    row = F.struct(
        F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.concat(F.lit("017-25-"), key)).alias("wcname"), F.concat(F.lit(" Drain "), key).alias("nameofwork"),
        F.when(F.col("o_orderkey") % 7 == 0, "tbd").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("amount"), F.when(F.col("o_orderkey") % 5 == 0, "7a").otherwise(key).alias("wbid"),
        F.concat(F.lit("&lt;b&gt;Division : D"), key, F.lit("&lt;br&gt;Contractor : 1234 C "), key, F.lit("&lt;br&gt;")).alias("jobcode"), F.concat(F.lit("SBR 9&lt;br&gt;BR "), key).alias("brdetails"),
    )
    whole = orders.groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("good"))
    kind = F.col("o_custkey") % 10
    broken = F.when(kind == 3, F.expr("substring(good, 1, length(good) - 9)")).when(kind == 5, '{"rError": "No data"}').when(kind == 7, "<html>502</html>").when(kind == 9, "  ").when(kind == 1, '{"total": 3}')
    path = shared_folder(spark)
    whole.select("o_custkey", F.coalesce(broken, "good").alias("value")).write.parquet(path)
    answered = grids.opened(spark.read.parquet(path))
    good = grids.payments(answered, "o_custkey").select("o_custkey", "work_order_id", "description", "contractor_name", F.col("sanctioned_amount").cast("double").alias("amount"), "fy", "division", "bill_ref", "bill_no", "odd")
    errors = answered.where("error IS NOT NULL").select("o_custkey", F.col("error"))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)


def feeds_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as a feed, RSS or Atom, with namespaces, nested markup and attributes, some cut off at their end: the first fifteen items."""
    events = table(spark, sf_dir, "events")
    number = F.col("event_id").cast("string")
    title = F.concat(F.lit("Event <b>number</b> "), number)
    item = F.concat(
        F.lit('<item guid="1"><dc:creator>x</dc:creator><title>'), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("<![CDATA["), title, F.lit("]]>"))).otherwise(F.when(F.col("event_id") % 3 == 1, title).otherwise("short")),
        F.lit("</title><description>A &amp;amp; B &lt;i&gt;c&lt;/i&gt;</description><link>http://x/"), number, F.lit("</link><pubDate>"), F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"),
    )
    entry = F.concat(F.lit('<entry><title type="html">'), title, F.lit('</title><link rel="self" href="http://y"/><link href="http://x/'), number, F.lit('"/><updated>'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry><entry><title>short</title></entry>"))
    all_of = lambda each: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", each.alias("x")))), lambda e: e["x"]), "")
    rss = F.concat(F.lit('<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/" version="2.0"><channel><title>T</title>'), all_of(item), F.when(F.col("user_id") % 3 == 0, "</channel></rss>").otherwise(""))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), all_of(entry), F.lit("</feed>"))
    path = shared_folder(spark)
    events.groupBy("user_id").agg(F.when(F.col("user_id") % 2 == 0, rss).otherwise(atom).alias("xml")).write.parquet(path)
    return markup.feed_entries(spark.read.parquet(path), "xml").select("user_id", "title", "body", "link", F.unix_timestamp("published").alias("seconds"), "place", "whole")


def signal_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as headlines of publishers with hashtags and mentions, cleaned; and sums of money as pages show them."""
    events = table(spark, sf_dir, "events")
    publisher = F.element_at(F.array(*(F.lit(p) for p in (" - The Hindu", " | NDTV News", " - ", " - Local Paper", ""))), (F.col("event_id") % 5 + 1).cast("int"))
    raw = F.concat(F.lit("  Road "), "event_id", F.lit("  #dug up by @city"), publisher)
    return events.select("event_id", text.headline_without_publisher(raw).alias("headline"), text.compact_rupees(F.col("event_id") * 7777).alias("rupees"), text.ward_money(F.col("event_id") * 5).alias("money"))


QUERIES = {f.__name__: f for f in (catalogue_orders, catalogue_files, tenders_paged, tenders_streamed, grid_answers, feeds_parsed, signal_headlines)}
ORACLES = {
    "catalogue_orders": """
WITH o AS (SELECT *, o_orderkey % 3 AS part, CAST(o_orderkey AS VARCHAR) AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderkey % 1000 AS net FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CASE WHEN part = 1 THEN (c_nationkey + 1) || '-24-' || k ELSE k END AS work_order_id, CAST(CASE part WHEN 0 THEN c_nationkey WHEN 1 THEN c_nationkey + 1 ELSE c_nationkey + 100 END AS INT) AS ward_no,
  'Drain, "north"' || chr(10) || 'of ' || c_mktsegment AS description, CASE WHEN part < 2 THEN '123456 M/s ' || c_name || '.,' || lpad(CAST(c_custkey AS VARCHAR), 10, '9') END AS contractor_raw,
  CASE WHEN part < 2 THEN c_name END AS contractor_name, CASE WHEN part < 2 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '9') END AS contractor_phone,
  CAST(amount AS DOUBLE) AS sanctioned_amount, CAST(CASE WHEN part < 2 THEN net ELSE 0 END AS DOUBLE) AS net_paid,
  CAST(CASE part WHEN 0 THEN greatest(0, amount - net) WHEN 1 THEN 12.5 ELSE amount END AS DOUBLE) AS deduction, '2013-2022' AS fy,
  CASE WHEN part = 0 THEN 2024 END AS resource_year, CASE part WHEN 1 THEN 'North ' || c_nationkey WHEN 2 THEN 'Zone ' || c_nationkey END AS resource_constituency FROM o""",
    "tenders_paged": f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS r, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders),
p AS (SELECT *, CAST((r - 1) // {PAGE} AS INT) AS page FROM t),
stops AS (SELECT o_orderstatus, min(page) AS last FROM p WHERE day <= DATE '1998-01-01' GROUP BY 1),
found AS (
  SELECT 'new' AS run, p.* FROM p LEFT JOIN stops USING (o_orderstatus) WHERE page <= coalesce(last, page) AND (day IS NULL OR day > DATE '1998-01-01')
  UNION ALL SELECT 'full', p.* FROM p WHERE o_orderstatus = 'P')
SELECT run, o_orderstatus AS stream, page, o_orderkey AS tender, CAST(o_custkey % 200 AS INT) AS ward_no, CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) * 100 / 1000 + 0.5) / 100 AS DOUBLE) AS lakh, CAST(day AS VARCHAR) AS issued FROM found""",
    "grid_answers": """
WITH o AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS k, o_custkey % 10 AS kind FROM orders),
a AS (SELECT o_custkey, kind, string_agg(DISTINCT 'x', '') AS x FROM o GROUP BY 1, 2),
first AS (SELECT o_custkey, arg_min(o, (CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE '017-25-' || k END, ' Drain ' || k)) AS f FROM o WHERE kind = 3 GROUP BY 1)
SELECT o_custkey, '017-25-' || k AS work_order_id, 'Drain ' || k AS description, 'C ' || k AS contractor_name, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount, '2024-25' AS fy, 'D' || k AS division, k AS bill_ref,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS bill_no, concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'amount' END, CASE WHEN o_orderkey % 5 = 0 THEN 'wbid' END) AS odd, CAST(NULL AS VARCHAR) AS error
FROM o WHERE kind NOT IN (1, 3, 5, 7, 9) AND o_orderkey % 13 <> 0
UNION ALL SELECT o_custkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  CASE kind WHEN 1 THEN 'no rows: {"total": 3}' WHEN 5 THEN 'portal: No data' WHEN 7 THEN 'not JSON: <html>502</html>' ELSE 'empty' END FROM a WHERE kind IN (1, 5, 7, 9)
UNION ALL SELECT o_custkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  'not JSON: ' || substr('[{"wcname":"' || CASE WHEN f.o_orderkey % 13 = 0 THEN '' ELSE '017-25-' || f.k END || '","nameofwork":" Drain ' || f.k || '","amount":"' || CASE WHEN f.o_orderkey % 7 = 0 THEN 'tbd' ELSE CAST(CAST(f.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END || '","wbid":"', 1, 60) FROM first""",
    "feeds_parsed": """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, user_id % 2 = 0 AS rss FROM events)
SELECT user_id, 'Event number ' || event_id AS title, CASE WHEN rss THEN 'A & B c' END AS body, 'http://x/' || event_id AS link, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, CAST(CASE WHEN rss THEN r ELSE 2 * r END AS INT) AS place, NOT rss OR user_id % 3 = 0 AS whole
FROM e WHERE CASE WHEN rss THEN r ELSE 2 * r END < 15 AND NOT (rss AND event_id % 3 = 2)""",
    "signal_headlines": """
SELECT event_id, 'Road ' || event_id || ' up by' || CASE WHEN event_id % 5 = 3 THEN ' - Local Paper' ELSE '' END AS headline,
  CASE WHEN event_id * 7777 >= 10000000 THEN printf('%.1f', event_id * 7777 / 1e7) || ' Cr' WHEN event_id * 7777 >= 100000 THEN printf('%.1f', event_id * 7777 / 1e5) || ' L' ELSE CAST(floor(event_id * 7777 / 1000.0 + 0.5) AS BIGINT) || 'K' END AS rupees,
  CASE WHEN event_id * 5 >= 10000 THEN 'Rs. ' || printf('%.1f', event_id * 5 / 10000.0) || ' Cr' ELSE 'Rs. ' || event_id * 5 || 'L' END AS money FROM events""",
    "tenders_streamed": """
WITH t AS (SELECT o_orderstatus AS stream, o_orderkey AS tender, CAST(o_orderdate AS DATE) AS day, o_orderdate FROM orders WHERE o_orderkey % 11 <> 0),
seen AS (SELECT stream, max(day) AS mark FROM t WHERE o_orderdate < TIMESTAMP '1997-06-01' GROUP BY 1)
SELECT stream, tender, CAST(day AS VARCHAR) AS issued FROM t LEFT JOIN seen USING (stream) WHERE o_orderdate < TIMESTAMP '1997-06-01' OR mark IS NULL OR day > mark""",
    "catalogue_files": """
WITH o AS (SELECT o_orderkey % 3 AS part, c_nationkey AS w FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CAST(CASE WHEN part = 0 THEN w END AS INT) AS resource_ward, CASE WHEN part = 0 THEN 2024 END AS resource_year, CASE part WHEN 1 THEN 'North ' || w WHEN 2 THEN 'Zone ' || w END AS resource_constituency, count(*) AS n FROM o GROUP BY ALL
UNION ALL SELECT 900, NULL, NULL, 0""",
}
