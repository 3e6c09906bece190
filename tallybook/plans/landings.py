"""Landings: the given tables written as the files that portals serve, read back by the sources, and held against SQL.

Every query writes its files to the shared folder, so readers meet real CSV, JSON, HTML and feeds whose size grows with
the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import bands, text
from tallybook.operators.classify import authority
from tallybook.operators.export import csv_document, index_page, write_json, write_pages
from tallybook.operators.joins import chained, linked_if_there
from tallybook.operators.merge import changed_rows, without_rows, write_guarded
from tallybook.operators.ranking import enabled, ranked
from tallybook.operators.rollup import positive_categories
from tallybook.session import shared_folder, table
from tallybook.sources import markup, records


def _padded(c: str, width: int, fill: str = "0") -> Column:
    return F.lpad(F.col(c).cast("string"), width, fill)


def _as_csv(df: DataFrame, header: bool = True) -> str:
    path = shared_folder(df.sparkSession)
    df.write.option("header", header).option("escape", '"').option("quoteAll", True).csv(path)
    return path


def _as_text(df: DataFrame, column: Column) -> str:
    path = shared_folder(df.sparkSession)
    df.select(column.alias("value")).write.text(path)
    return path


def csv_work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a portal's CSV: names with codes and phones, quoted commas and line breaks, amounts that are no numbers."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    year = (F.col("o_orderkey") % 7 + 20).cast("string")
    raw = joined.select(
        F.concat(_padded("c_nationkey", 3), F.lit("-"), year, F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("wo num"),
        F.concat(F.lit('Drain, "north"\nof '), "c_mktsegment").alias("wodetails"),
        F.concat(F.lit("123456 M/s "), "c_name", F.lit(".,"), _padded("c_custkey", 10, "9")).alias("contractor"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"),
        F.when(F.col("o_orderkey") % 3 == 0, "abc").otherwise((F.col("o_orderkey") % 1000).cast("string")).alias("nett"),
        F.when(F.col("o_orderkey") % 2 == 0, "0").otherwise("25.5 net").alias("deduction"),
    )
    read = records.work_orders(records.read_csv(spark, _as_csv(raw), multi_line=True))
    return read.select("work_order_id", "ward_no", "description", "contractor_name", "contractor_phone", *(F.col(c).cast("double").alias(c) for c in ("sanctioned_amount", "net_paid", "deduction")), "fy")


def csv_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as positional rows of thirteen fields, counted by ward and year."""
    lines = table(spark, sf_dir, "lineitem")
    blank = lambda k: F.lit(None).cast("string").alias(f"x{k}")
    row = lines.select(
        F.when(F.col("l_returnflag") == "N", "New").otherwise("Renewal").alias("a"), F.concat(F.lit("Issued "), F.year("l_shipdate") + 14).alias("b"), blank(2), blank(3), blank(4),
        F.when(F.col("l_linenumber") % 2 == 0, "\\N").otherwise(F.col("l_linestatus")).alias("trade"), blank(6), blank(7), blank(8), blank(9),
        F.concat(F.lit("Rs "), F.format_number("l_extendedprice", 2)).alias("fee"), blank(11), F.concat(F.lit("Ward "), F.col("l_suppkey") % 20).alias("ward"),
    )
    names = [f"_c{k}" for k in range(13)]
    read = records.licences(records.read_csv(spark, _as_csv(row, header=False), header=False, schema=records.strings(*names)))
    return read.groupBy("ward_name", "year").agg(F.count("*").alias("n"), F.count_if("is_new").alias("fresh"), F.count("trade").alias("trades"), F.sum(F.col("fee").cast("decimal(18,2)")).cast("double").alias("fees"))


def csv_grievances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as complaints; ward names shorter than two characters and blank lines are dropped."""
    raw = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 10 == 0, "W").otherwise(F.concat(F.lit(" Ward "), F.col("user_id") % 10)).alias("Ward Name"), F.col("event_type").alias("Grievance Status"))
    return records.grievances(records.read_csv(spark, _as_csv(raw))).groupBy("ward_name", "status").agg(F.count("*").alias("n"))


def csv_fund_spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' balances with thousands commas; rows without a number are dropped."""
    raw = table(spark, sf_dir, "supplier").select(_padded("s_suppkey", 4).alias("a"), F.concat(F.lit("20"), _padded("s_nationkey", 2)).alias("b"), F.lit("").alias("c"), F.lit("").alias("d"), F.lit("").alias("e"), F.when(F.col("s_suppkey") % 5 == 0, "n/a").otherwise(F.format_number("s_acctbal", 2)).alias("f"))
    read = records.fund_spending(records.read_csv(spark, _as_csv(raw, header=False), header=False, schema=records.strings(*(f"_c{k}" for k in range(6)))))
    return read.groupBy("fy").agg(F.count("*").alias("n"), F.sum(F.col("lakh").cast("decimal(18,2)")).cast("double").alias("lakh"))


def tenders_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tenders: those newer than the latest one known, dates that can't be read stay; nothing known starts in 2020."""
    orders = table(spark, sf_dir, "orders")
    landed = orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("T-"), "o_orderkey")).alias("tenderNumber"), F.concat(F.lit("Works in Ward No. "), F.col("o_custkey") % 200).alias("title"),
        F.lit("Roads").alias("deptName"), (F.col("o_totalprice") * 100).alias("ecv"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 11 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy HH:mm")).alias("publishedDate"), F.lit(None).cast("string").alias("tenderClosureDate"),
    )
    path = shared_folder(spark)
    write_json(landed, path)
    read = spark.read.schema(landed.schema).json(path)
    known = orders.where("o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    runs = {"known": known, "nothing": known.where("false")}
    found = [records.tenders_since(read, records.high_water_mark(k, "o_orderdate")).withColumn("run", F.lit(name)) for name, k in runs.items()]
    value = F.sum(F.col("value_lakh").cast("decimal(18,2)")).cast("double").alias("lakh")
    return reduce(DataFrame.unionByName, found).groupBy("run", "status").agg(F.count("*").alias("n"), F.count("issued_date").alias("dated"), F.min("tender_id").alias("first"), F.sum("ward_no").alias("wards"), value)


def source_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a source is loaded: it has to have more rows than the total known, unless none is."""
    events = table(spark, sf_dir, "events")
    totals = events.groupBy("event_type").agg(F.count("*").alias("total"))
    cases = [("same", events, totals), ("more", events, totals.where("event_type <> 'click'")), ("unknown", events, totals.where("false")), ("fewer", events.where("event_type = 'click'"), totals)]
    loads = [source.agg(F.count("*").alias("rows")).select(F.lit(name).alias("source"), "rows", F.lit(records.has_news(source, known, "total")).alias("loads")) for name, source, known in cases]
    return reduce(DataFrame.unionByName, loads)


def ward_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as features with seven-digit codes; some codes are no numbers or of no ward."""
    code = F.when(F.col("p_size") == 1, "n/a").otherwise((F.col("p_partkey") + 2003000).cast("string"))
    return records.ward_code_counts(table(spark, sf_dir, "part").select(code.alias("code")))


def json_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as map points, nodes with coordinates and ways with a centre; zero and missing coordinates are dropped."""
    lat, lon = F.col("user_id") % 5 + F.lit(0.0), F.minute("ts") + F.lit(0.5)
    way = F.col("event_id") % 3 == 0
    landed = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.when(~way, lat).alias("lat"), F.when(~way, lon).alias("lon"), F.when(way, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("center"))
    path = shared_folder(spark)
    write_json(landed, path)
    return records.points(spark.read.schema("category string, lat double, lon double, center struct<lat: double, lon: double>").json(path)).groupBy("category").agg(F.count("*").alias("n"), F.sum("lat").alias("lats"))


def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sanction entries, as affidavits behind a byte order mark, and two names kept by hand."""
    suppliers = table(spark, sf_dir, "supplier")
    landed = suppliers.select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("caption"), F.array(F.upper("s_name")).alias("names"), F.array(F.lit("debarred"), F.col("s_nationkey").cast("string")).alias("datasets"))
    path = shared_folder(spark)
    write_json(landed, path)
    listed = records.sanctions(spark.read.schema("caption string, names array<string>, datasets array<string>").json(path))
    rows = suppliers.groupBy("s_nationkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 0, 1).alias("cases"))))).alias("value"))
    path = shared_folder(spark)
    rows.select("s_nationkey", F.concat(F.lit("\ufeff"), "value").alias("value")).write.partitionBy("s_nationkey").text(path)  # a file each
    papers = records.affidavits(spark, path, {"name": "string", "cases": "int", "party": "string"})
    papers = papers.select(F.col("name").alias("listed_name"), F.concat(F.lit("cases "), F.coalesce("cases", F.lit(0))).alias("source"))
    return listed.unionByName(papers).unionByName(records.literal_list(spark, [("Alpha Works", "by hand"), ("Beta Works", "by hand")])).groupBy("source").agg(F.count("*").alias("n"), F.min("listed_name").alias("first"))


def listing_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as listings of posts: the first five children of each, flattened."""
    post = F.struct(F.struct(F.col("event_id").alias("id"), F.concat(F.lit("About "), "event_type").alias("title")).alias("data"))
    children = F.sort_array(F.collect_list(post))
    landed = table(spark, sf_dir, "events").groupBy("user_id").agg(F.struct(children.alias("children")).alias("data"))
    path = shared_folder(spark)
    write_json(landed, path)
    read = spark.read.schema("user_id bigint, data struct<children: array<struct<data: struct<id: bigint, title: string>>>>").json(path)
    return records.listing_children(read).select("user_id", "id", "title")


def map_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as unit squares, in GeoJSON and in TopoJSON of two arcs each (one read backwards): corners and extent of the rings."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 5).alias("x"), F.floor(F.col("n_nationkey") / 5).alias("y"), "n_nationkey")
    x, y = F.col("x") + F.lit(10.0), F.col("y") + F.lit(20.0)
    ring = F.array(*(F.array(x + dx, y + dy) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    shape = F.struct(F.struct(F.col("name")).alias("properties"), F.when(F.col("n_nationkey") % 7 != 6, F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("geometry"))
    geo = records.features(spark, _as_text(nations.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("n_nationkey", shape.alias("f")))).getField("f").alias("features"))).alias("value")), F.col("value")), "name")
    step = lambda *points: F.array(*(F.array(F.lit(a).cast("bigint") if isinstance(a, int) else a, F.lit(b).cast("bigint") if isinstance(b, int) else b) for a, b in points))
    start = (F.col("x") * 2, (F.col("y") * 2).cast("bigint"))
    arcs = F.array(step(start, (2, 0), (0, 2)), step(start, (0, 2), (2, 0)))
    each = nations.select("n_nationkey", arcs.alias("arcs"), F.struct(F.when(F.col("n_nationkey") % 7 != 6, "Polygon").alias("type"), F.concat(F.lit("[["), F.col("n_nationkey") * 2, F.lit(",-"), F.col("n_nationkey") * 2 + 2, F.lit("]]")).alias("arcs"), F.create_map(F.lit("name"), "name").alias("properties")).alias("g"))
    held = each.agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "arcs", F.to_json("g").alias("g")))).alias("all"))
    transform = F.struct(F.array(F.lit(0.5), F.lit(0.5)).alias("scale"), F.array(F.lit(10.0), F.lit(20.0)).alias("translate"))
    whole = held.select(F.to_json(transform).alias("t"), F.to_json(F.flatten("all.arcs")).alias("arcs"), F.array_join("all.g", ",").alias("gs"))
    path = _as_text(whole, F.concat(F.lit('{"transform":'), "t", F.lit(',"arcs":'), "arcs", F.lit(',"objects":{"boundaries":{"geometries":['), "gs", F.lit("]}}}")))
    schema = "transform struct<scale: array<double>, translate: array<double>>, arcs array<array<array<bigint>>>, objects struct<boundaries: struct<geometries: array<struct<type: string, arcs: string, properties: map<string, string>>>>>"
    topo = records.topology_features(spark.read.schema(schema).json(path), "boundaries", "name")
    told = geo.withColumn("format", F.lit("geo")).unionByName(topo.withColumn("format", F.lit("topo")))
    lon, lat = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    return told.select("format", "id", F.size("ring").alias("corners"), F.array_min(lon).alias("west"), F.array_max(lon).alias("east"), F.array_min(lat).alias("south"), F.array_max(lat).alias("north"), (F.get("ring", F.lit(0)) == F.element_at("ring", -1)).alias("closed"))


def html_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pages of HTML tables, one a nation: numbered rows, and names without headings and scraps."""
    row = F.concat(F.lit("<tr class=r><td>"), "s_suppkey", F.lit("</td><td> <b>"), "s_name", F.lit("</b> &amp; Co</td><td>a</td><td>"), F.round("s_acctbal").cast("bigint"), F.lit("</td><td>x</td></tr>"))
    page = F.concat(F.lit("<table><tr><th>Sl</th></tr><tr><td>Sl No</td><td>Name</td></tr>"), F.array_join(F.sort_array(F.collect_list(row)), "\n"), F.lit("</table>"))
    pages = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(page.alias("html"))
    path = shared_folder(spark)
    pages.write.parquet(path)
    read = spark.read.parquet(path)
    numbered = markup.table_rows(read, F.col("html")).select(F.get("cells", F.lit(1)).alias("name"), F.get("cells", F.lit(3)).cast("bigint").alias("amount"))
    named = markup.listed_names(read, F.col("html"), 1, "portal", ("Name",)).select(F.col("listed_name").alias("name"), F.lit(None).cast("bigint").alias("amount"))
    return numbered.withColumn("kind", F.lit("row")).unionByName(named.withColumn("kind", F.lit("name")))


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type as RSS and Atom feeds, with the zones that feeds use, read back to moments."""
    events = table(spark, sf_dir, "events")
    stamp = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.when(F.col("event_id") % 20 == 0, " +0530").otherwise(" GMT"))
    title = F.concat(F.lit("Event number "), "event_id")
    item = F.concat(F.lit("<item><title><![CDATA["), title, F.lit(" <b>new</b>]]></title><description>A &amp; B</description><link>http://x/"), "event_id", F.lit("</link><pubDate>"), stamp, F.lit("</pubDate></item>"))
    entry = F.concat(F.lit("<entry><title>"), title, F.lit('</title><link rel="x" href="http://x/'), "event_id", F.lit('"/><updated>'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry><entry><title>short</title></entry>"))
    feed = lambda tag, each: F.concat(F.lit(f"<{tag}>"), F.array_join(F.sort_array(F.collect_list(each)), ""), F.lit(f"</{tag}>"))
    xml = events.groupBy("user_id").agg(F.when(F.col("user_id") % 2 == 0, feed("rss", item)).otherwise(feed("feed", entry)).alias("xml"))
    path = shared_folder(spark)
    xml.write.parquet(path)
    return markup.feed_items(spark.read.parquet(path), F.col("xml")).select("user_id", "title", "body", "link", F.unix_timestamp("published").alias("seconds"))


def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, wards, dates, contacts and cells taken out of texts made of order fields."""
    orders = table(spark, sf_dir, "orders")
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice")
    day = F.col("o_orderdate").cast("timestamp")
    cell = F.concat(F.lit("&lt;b&gt;Start : "), F.date_format(day, "d-MMM-yyyy"), F.lit("&lt;br&gt;Division : D"), key, F.lit("&lt;br&gt;Budget : &lt;br&gt;Contractor : C "), key, F.lit("&lt;br&gt;"))
    job = text.job_fields(cell)
    segments = F.concat(F.lit("SBR 9&lt;br&gt;BR "), key, F.lit("<BR/>RA 7"))
    return orders.select(
        "o_orderkey",
        text.leading_number(F.concat(price.cast("decimal(18,2)").cast("string"), F.lit(" rupees"))).alias("leading"),
        text.thousands_number(F.format_number(price, 2)).alias("thousands"),
        text.digits_money(F.concat(F.lit("Rs. "), F.lit("only "), key)).alias("digits"),
        text.deduction_or_rest(F.when(F.col("o_orderkey") % 2 == 0, 5.0).otherwise(0.0), F.lit(100.0), F.col("o_orderkey") % 200 + F.lit(0.0)).alias("deduction"),
        text.ward_of_order(F.lit(None).cast("int"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("17-24-"), key)), F.lit("23 North")).alias("ward"),
        text.ward_in_title(F.concat(F.lit("Drain, ward no."), F.col("o_custkey") % 100)).alias("title_ward"),
        text.ward_in_file_name(F.concat(F.lit("orders_Ward-"), F.col("o_custkey") % 100, F.lit(".csv"))).alias("file_ward"),
        text.ward_of_label(F.concat(F.lit("o0"), F.col("o_custkey") % 90 + 10, F.lit(" Name"))).alias("label_ward"),
        text.year_in(F.concat(F.lit("FY "), F.year(day))).alias("year"),
        text.date_dd_mm_yyyy(F.date_format(day, "dd-MM-yyyy HH:mm")).cast("string").alias("day"),
        job["start_date"].cast("string").alias("start_day"), job["division"].alias("division"), job["budget_head"].alias("budget"), job["contractor_raw"].alias("contractor"),
        text.labelled_segment(segments, "BR").alias("segment"),
        text.lakh_of_rupees(price.cast("decimal(18,2)") * 100).cast("double").alias("lakh"),
        F.array_join(text.phones(F.concat(F.lit("call 080-"), F.lpad(key, 8, "2"), F.lit(" or 98450"), F.lpad(key, 5, "1")).substr(1, 200)), ",").alias("phones"),
        F.array_join(text.emails(F.concat(F.lit("Mail A."), key, F.lit("@Example.org now"))), ",").alias("emails"),
        text.without_code_suffix(F.concat(F.lit("Name ("), key, F.lit(") "))).alias("bare"),
        text.title_case(F.concat(F.lit("  north "), F.col("o_orderpriority"))).alias("titled"),
        text.short_money(F.col("o_orderkey") % 300).alias("money"), text.rupees(F.col("o_orderkey") * 1000).alias("rupees"),
    )


def ranked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders numbered by value over the whole table, with a link to their ward's page where there is one."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    numbered = ranked(orders.select("o_orderkey", "c_nationkey", F.col("o_totalprice").cast("decimal(18,2)").alias("value")), [], [F.desc_nulls_last("value"), F.asc("o_orderkey")])
    pages = table(spark, sf_dir, "nation").where("n_regionkey <> 2")
    link = F.concat(F.lit("/ward/"), F.col("c_nationkey"))
    return linked_if_there(numbered, "c_nationkey", pages, "n_nationkey", link).select("o_orderkey", "rank", "link")


def spend_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values of each ward by status as columns, unpivoted to the categories above zero."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    amount = lambda s: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias(s)
    wide = orders.groupBy("c_nationkey").agg(amount("F"), amount("O"), amount("P"), F.lit(0.0).alias("none"))
    return positive_categories(wide, ["c_nationkey"], ["F", "O", "P", "none"])


def report_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single reports rejected, approved and deleted; a later empty batch leaves the written table alone."""
    reports = table(spark, sf_dir, "events").select("event_id", "event_type", F.lit("pending").alias("status"))
    changed = changed_rows(reports, F.col("event_id") == 3, status="rejected")
    changed = changed_rows(changed, F.col("event_id").isin(4, 5), status=F.concat(F.lit("approved "), "event_type"))
    changed = without_rows(changed, F.col("event_id") == 6)
    path = shared_folder(spark)
    write_guarded(changed, path)
    write_guarded(changed.where("false"), path)
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"))


def service_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of in-time shares, questions and growth, and the authority of a report's type."""
    events = table(spark, sf_dir, "events")
    share, growth = F.col("event_id") % 101, F.col("event_id") % 240 - 20
    kind = F.element_at(F.array(*(F.lit(x) for x in ("pothole", "signal", "hoarding", "other", "click"))), (F.col("user_id") % 5 + 1).cast("int"))
    told = events.select(bands.in_time_band(share).alias("in_time"), bands.questions_band(F.col("user_id") % 15).alias("questions"), bands.growth_band(growth).alias("growth"), authority(kind).alias("authority"))
    return told.groupBy("in_time", "questions", "growth", "authority").agg(F.count("*").alias("n"))


FOOTER = ["Spending: work orders, by ward", 'All data is from "public" records']


def csv_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a CSV document with its attribution, and the answer where nothing is found."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit('A "'), "s_name", F.lit('", Co')).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("ward"))
    return csv_document(rows, FOOTER).withColumn("found", F.lit(True)).unionByName(csv_document(rows.where("false"), FOOTER).withColumn("found", F.lit(False)))


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per nation and an index by region, written twice: the second run's pages replace the first's."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pages = nations.select("n_nationkey", F.concat(F.lit("# "), "n_name").alias("page"))
    path = shared_folder(spark)
    write_pages(pages, path, "n_nationkey", "page")
    write_pages(pages.where("n_nationkey < 20"), path, "n_nationkey", "page")
    written_pages = spark.read.text(path, wholetext=True).select(F.col("n_nationkey").cast("string").alias("place"), F.trim(F.regexp_replace("value", "\n$", "")).alias("page"))
    index = index_page(nations.where("n_nationkey < 20").withColumn("area", F.when(F.col("n_regionkey") > 0, F.col("r_name"))), "Wards", "area", "n_nationkey", "n_name")
    return written_pages.unionByName(index.select(F.col("area").alias("place"), F.col("section").alias("page")))


def chained_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers to their nation, its region and the region's office; some hops are missing."""
    offices = table(spark, sf_dir, "region").where("r_regionkey <> 1").select(F.col("r_name").alias("office_of"), F.concat(F.lit("office "), "r_regionkey").alias("office"))
    nations = table(spark, sf_dir, "nation").where("n_nationkey <> 3").select("n_nationkey", "n_regionkey")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    found = chained(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), [(nations, "n_nationkey", "s_nationkey"), (regions, "r_regionkey", "n_regionkey"), (offices, "office_of", "r_name")])
    return found.select("s_suppkey", "r_name", "office")


def feature_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of features that a city has or hasn't, and the wards that count by label and bucket."""
    events, features = table(spark, sf_dir, "events"), {"signals": True, "water": False}
    gated = [enabled(features, name, events.where(F.col("event_type") == kind)).agg(F.count("*").alias("n")).withColumn("feature", F.lit(name)) for name, kind in (("signals", "error"), ("water", "click"), ("unknown", "view"))]
    label = F.concat(F.when(F.col("n_nationkey") % 4 == 0, "oo").otherwise(""), _padded("n_nationkey", 3), F.lit(" "), F.col("n_name"))
    wards = table(spark, sf_dir, "nation").where(text.is_current_ward(label, F.when(F.col("n_nationkey") == 5, 300).otherwise(F.col("n_nationkey")))).agg(F.count("*").alias("n")).withColumn("feature", F.lit("wards"))
    return reduce(DataFrame.unionByName, [*gated, wards])


SQUARES_SQL = "squares AS (SELECT n_name AS id, n_nationkey % 5 + 10.0::DOUBLE AS west, n_nationkey // 5 + 20.0::DOUBLE AS south FROM nation WHERE n_nationkey % 7 <> 6)"

QUERIES = {
    f.__name__: f
    for f in (
        csv_work_orders, csv_licences, csv_grievances, csv_fund_spending, tenders_incremental, source_guard, ward_codes, json_points, json_lists, listing_posts, map_features,
        html_lists, feeds, parsed_values, ranked_orders, spend_categories, report_changes, service_bands, csv_download, report_pages, chained_lookup, feature_gates,
    )
}
ORACLES = {
    "csv_work_orders": """
WITH o AS (SELECT *, 20 + o_orderkey % 7 AS yy, round(o_totalprice, 2) AS amount, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 1000 END AS net FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || '-' || yy || '-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS work_order_id, c_nationkey AS ward_no,
       'Drain, "north"' || chr(10) || 'of ' || c_mktsegment AS description, c_name AS contractor_name, lpad(CAST(c_custkey AS VARCHAR), 10, '9') AS contractor_phone,
       CAST(CAST(amount AS DECIMAL(18,2)) AS DOUBLE) AS sanctioned_amount, CAST(net AS DOUBLE) AS net_paid,
       CASE WHEN o_orderkey % 2 = 1 THEN 25.5 ELSE CAST(greatest(0, CAST(amount AS DECIMAL(18,2)) - net) AS DOUBLE) END AS deduction, (2000 + yy - 1) || '-' || yy AS fy FROM o""",
    "csv_licences": """
WITH l AS (SELECT 'Ward ' || (l_suppkey % 20) AS ward_name, CAST(year(l_shipdate) + 14 AS INT) AS year, l_returnflag, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS fee FROM lineitem)
SELECT ward_name, year, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS fresh, count(*) FILTER (WHERE l_linenumber % 2 = 1) AS trades, CAST(sum(fee) AS DOUBLE) AS fees FROM l WHERE year BETWEEN 2015 AND 2030 GROUP BY 1, 2""",
    "csv_grievances": "SELECT 'Ward ' || (user_id % 10) AS ward_name, event_type AS status, count(*) AS n FROM events WHERE user_id % 10 <> 0 GROUP BY 1, 2",
    "csv_fund_spending": "SELECT '20' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS fy, count(*) AS n, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS lakh FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY 1",
    "tenders_incremental": """
WITH t AS (SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'T-' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS tender_id, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, o_custkey % 200 AS ward,
                  CAST(floor(o_totalprice * 100 / 1000 + 0.5) / 100 AS DECIMAL(18,2)) AS value FROM orders),
runs AS (SELECT 'known' AS run, coalesce(max(CAST(o_orderdate AS DATE)), DATE '2020-01-01') AS mark FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' UNION ALL SELECT 'nothing', DATE '2020-01-01')
SELECT run, status, count(*) AS n, count(day) AS dated, min(tender_id) AS first, CAST(sum(ward) AS BIGINT) AS wards, CAST(sum(value) AS DOUBLE) AS lakh FROM t CROSS JOIN runs WHERE day IS NULL OR day > mark GROUP BY 1, 2""",
    "source_guard": """
WITH e AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS c FROM events)
SELECT 'same' AS source, n AS rows, n > n OR n = 0 AS loads FROM e UNION ALL SELECT 'more', n, n > n - c OR n = c FROM e UNION ALL SELECT 'unknown', n, true FROM e UNION ALL SELECT 'fewer', c, c > n OR n = 0 FROM e""",
    "ward_codes": "SELECT CAST((p_partkey + 2003000) % 1000 AS INT) AS ward_no, count(*) AS n FROM part WHERE p_size <> 1 AND (p_partkey + 2003000) % 1000 BETWEEN 1 AND 200 GROUP BY 1",
    "json_points": "SELECT event_type AS category, count(*) AS n, sum(CAST(user_id % 5 AS DOUBLE)) AS lats FROM events WHERE user_id % 5 <> 0 GROUP BY 1",
    "json_lists": """
SELECT source, count(*) AS n, min(name) AS first FROM (
  SELECT 'debarred, ' || s_nationkey AS source, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE upper(s_name) END AS name FROM supplier
  UNION ALL SELECT CASE WHEN s_acctbal < 0 THEN 'cases 1' ELSE 'cases 0' END, s_name FROM supplier
  UNION ALL SELECT 'by hand', n FROM (VALUES ('Alpha Works'), ('Beta Works')) v(n)) GROUP BY 1""",
    "listing_posts": "SELECT user_id, event_id AS id, 'About ' || event_type AS title FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 5",
    "map_features": f"WITH {SQUARES_SQL} SELECT f AS format, id, 5 AS corners, west, west + 1 AS east, south, south + 1 AS north, true AS closed FROM squares CROSS JOIN (VALUES ('geo'), ('topo')) v(f)",
    "html_lists": """
SELECT s_name || ' & Co' AS name, CAST(round(s_acctbal) AS BIGINT) AS amount, 'row' AS kind FROM supplier
UNION ALL SELECT DISTINCT s_name || ' & Co', CAST(NULL AS BIGINT), 'name' FROM supplier""",
    "feeds": """
SELECT user_id, 'Event number ' || event_id || CASE WHEN user_id % 2 = 0 THEN ' new' ELSE '' END AS title, CASE WHEN user_id % 2 = 0 THEN 'A & B' END AS body, 'http://x/' || event_id AS link,
       CAST(floor(epoch(ts)) AS BIGINT) - CASE WHEN user_id % 2 = 0 AND event_id % 20 = 0 THEN 19800 ELSE 0 END AS seconds FROM events""",
    "parsed_values": """
WITH o AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)
SELECT o_orderkey, CAST(price AS DOUBLE) AS leading, CAST(price AS DOUBLE) AS thousands, CAST('.' || k AS DOUBLE) AS digits, CASE WHEN o_orderkey % 2 = 0 THEN 5.0::DOUBLE ELSE greatest(0.0::DOUBLE, 100.0::DOUBLE - o_orderkey % 200) END AS deduction,
       CASE WHEN o_orderkey % 2 = 0 THEN 17 ELSE 23 END AS ward, CAST(o_custkey % 100 AS INT) AS title_ward, CAST(o_custkey % 100 AS INT) AS file_ward, CAST(o_custkey % 90 + 10 AS INT) AS label_ward, CAST(year(o_orderdate) AS INT) AS year,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_day, 'D' || k AS division, CAST(NULL AS VARCHAR) AS budget, 'C ' || k AS contractor, k AS segment,
       CAST(floor(price * 100 / 1000 + 0.5) / 100 AS DOUBLE) AS lakh, '080-' || lpad(k, 8, '2') || ',98450' || lpad(k, 5, '1') AS phones, 'a.' || k || '@example.org' AS emails, 'Name' AS bare,
       'North ' || string_split(o_orderpriority, ' ')[1][1:1] || lower(string_split(o_orderpriority, ' ')[1][2:]) || coalesce(' ' || upper(string_split(o_orderpriority, ' ')[2][1:1]) || lower(string_split(o_orderpriority, ' ')[2][2:]), '') AS titled,
       CASE WHEN o_orderkey % 300 >= 100 THEN 'Rs ' || CAST(floor(o_orderkey % 300 / 100.0 + 0.5) AS INT) || ' Cr' ELSE 'Rs ' || (o_orderkey % 300) || ' L' END AS money, trim(format('{:,}', o_orderkey * 1000)) AS rupees FROM o""",
    "ranked_orders": """
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC NULLS LAST, o_orderkey) AS INT) AS rank, CASE WHEN n_nationkey IS NOT NULL THEN '/ward/' || c_nationkey END AS link
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey""",
    "csv_download": """
SELECT 0 AS part, 's_suppkey,name,ward' AS line, true AS found UNION ALL SELECT 0, 'No data available', false
UNION ALL SELECT 1, s_suppkey || ',"A ""' || s_name || '"", Co",' || CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE '' END, true FROM supplier
UNION ALL SELECT 2, l, true FROM (VALUES (''), ('# DATA SOURCES & ATTRIBUTION'), ('"Spending: work orders, by ward"'), ('"All data is from ""public"" records"')) v(l)""",
    "report_pages": """
SELECT CAST(n_nationkey AS VARCHAR) AS place, '# ' || n_name AS page FROM nation WHERE n_nationkey < 20
UNION ALL SELECT area, '# Wards' || chr(10) || chr(10) || '## ' || area || chr(10) || string_agg('| ' || n_nationkey || ' | [' || n_name || '](ward-' || n_nationkey || '.md) |', chr(10) ORDER BY n_nationkey)
FROM (SELECT *, CASE WHEN n_regionkey > 0 THEN r_name ELSE 'Unassigned' END AS area FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20) GROUP BY area""",
    "chained_lookup": """
SELECT s_suppkey, r_name, CASE WHEN r_regionkey <> 1 THEN 'office ' || r_regionkey END AS office
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 3) ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "feature_gates": """
SELECT 'signals' AS feature, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'water', 0 UNION ALL SELECT 'unknown', 0
UNION ALL SELECT 'wards', count(*) FROM nation WHERE n_nationkey % 4 <> 0 AND n_nationkey <> 5""",
    "spend_categories": """
SELECT c_nationkey, o_orderstatus AS category, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1, 2 HAVING sum(CAST(o_totalprice AS DECIMAL(18,2))) > 0""",
    "report_changes": """
SELECT status, count(*) AS n FROM (SELECT CASE WHEN event_id = 3 THEN 'rejected' WHEN event_id IN (4, 5) THEN 'approved ' || event_type ELSE 'pending' END AS status FROM events WHERE event_id <> 6) GROUP BY 1""",
    "service_bands": """
WITH b AS (SELECT CASE WHEN event_id % 101 >= 90 THEN 'good' WHEN event_id % 101 >= 75 THEN 'fair' ELSE 'poor' END AS in_time, CASE WHEN user_id % 15 = 0 THEN 'poor' WHEN user_id % 15 < 10 THEN 'fair' ELSE 'good' END AS questions,
  CASE WHEN event_id % 240 - 20 > 100 THEN 'steep' ELSE 'normal' END AS growth, CASE user_id % 5 WHEN 0 THEN 'BBMP' WHEN 1 THEN 'BTP' WHEN 2 THEN 'BBMP' WHEN 3 THEN 'BBMP' END AS authority FROM events)
SELECT in_time, questions, growth, authority, count(*) AS n FROM b GROUP BY ALL""",
}
