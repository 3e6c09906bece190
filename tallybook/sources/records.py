"""CSV, JSON and API landings of public portals, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallybook.functions.text import deduction_or_rest, digits_money, fiscal_year_of_code, first_filled, leading_number, thousands_number, trailing_phone, vendor_name, ward_in_file_name, ward_of_order, year_in


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False, header: bool = True, schema: StructType | None = None, quotes: bool = True) -> DataFrame:
    """Every column as trimmed text; blank lines are dropped; `source_file` names the file a row is from.

    Without a schema all files must have one header; another one is an error (`catalogue.read_layouts` reads files of several).
    With `quotes` off a quotation mark is a character like any other and every comma parts fields.
    """
    reader = spark.read.option("header", header).option("multiLine", multi_line).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("escape", '"').option("mode", "PERMISSIVE")
    if not quotes:
        reader = reader.option("quote", "")
    df = (reader.schema(schema) if schema else reader.option("enforceSchema", not header)).csv(path)
    filled = F.concat_ws("", *(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in df.columns)) != ""
    return df.where(filled).select("*", F.col("_metadata.file_name").alias("source_file"))


def column(df: DataFrame, *names: str) -> Column:
    """The first filled one of the headers that the file has; null if it has none of them."""
    there = [F.col(f"`{n}`") for n in names if n in df.columns]
    return first_filled(*there) if there else F.lit(None).cast("string")


# What the portals call the fields of a work order, in the order in which a filled one counts.
ORDER_FIELDS = {
    "order": ("wo num", "Work Order Reference Number", "work_order_id", "id"),
    "amount": ("amount", "Amount", "sanctioned_amount"),
    "net": ("nett", "Nett", "net_paid", "Amount Paid"),
    "deduction": ("deduction", "Deduction", "Balance"),
    "vendor": ("contractor", "Contractor Name & Phone"),
    "ward": ("Ward", "ward", "ward_no", "ward no"),
    "details": ("wodetails", "Work Order Code & Description", "description"),
}


def work_orders(raw: DataFrame, fiscal_year: str | None = None, ward_of_source: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed work orders from any of the portals' headers, and the columns to keep; ward from its source (a column, else the file's name), order id or ward column."""
    field = {name: column(raw, name, *headers) if name not in headers else column(raw, *headers) for name, headers in ORDER_FIELDS.items()}
    order_id, vendor = field["order"], field["vendor"]
    amount, net = (F.coalesce(leading_number(field[c]), F.lit(0.0)) for c in ("amount", "net"))
    stated = leading_number(field["deduction"])
    in_name = ward_in_file_name(F.col("source_file")) if "source_file" in raw.columns else F.lit(None)
    ward = ward_of_order(F.col(ward_of_source) if ward_of_source else in_name, order_id, field["ward"])
    return raw.select(
        order_id.alias("work_order_id"), ward.alias("ward_no"), F.substring(field["details"], 1, 1000).alias("description"),
        F.substring(vendor, 1, 500).alias("contractor_raw"), F.substring(vendor_name(vendor), 1, 300).alias("contractor_name"), trailing_phone(vendor).alias("contractor_phone"),
        amount.cast("decimal(18,2)").alias("sanctioned_amount"), net.cast("decimal(18,2)").alias("net_paid"), deduction_or_rest(stated, amount, net).cast("decimal(18,2)").alias("deduction"),
        F.coalesce(F.lit(fiscal_year), fiscal_year_of_code(order_id)).alias("fy"), *keep,
    ).where(F.col("work_order_id").isNotNull() & F.col("ward_no").isNotNull())


def licences(raw: DataFrame) -> DataFrame:
    """Trade licences from positional rows of at least 13 fields: type, year, trade, fee, ward; years 2015 to 2030 only."""
    year = year_in(F.col("_c1"))
    return raw.where(F.col("_c12").isNotNull() & year.between(2015, 2030)).select(
        F.col("_c12").alias("ward_name"), year.alias("year"), (F.col("_c0") == "New").alias("is_new"), F.nullif(F.col("_c5"), F.lit("\\N")).alias("trade"), digits_money(F.col("_c10")).alias("fee")
    )


def grievances(raw: DataFrame) -> DataFrame:
    """Ward and status; ward names shorter than two characters are dropped."""
    return raw.select(column(raw, "Ward Name").alias("ward_name"), column(raw, "Grievance Status").alias("status")).where(F.length("ward_name") >= 2)


def fund_spending(raw: DataFrame) -> DataFrame:
    """Fiscal year and lakh from positional rows; rows without a year or a number are dropped."""
    return raw.select(F.col("_c1").alias("fy"), thousands_number(F.col("_c5")).alias("lakh")).where("fy IS NOT NULL AND lakh IS NOT NULL AND NOT isnan(lakh)")


def tenders_since(landed: DataFrame, mark: Column) -> DataFrame:
    """Tenders newer than the high-water mark; those whose date can't be read are kept."""
    from tallybook.functions.text import date_dd_mm_yyyy, lakh_of_rupees, ward_in_title

    issued = date_dd_mm_yyyy(F.col("publishedDate"))
    return landed.select(
        F.coalesce(F.col("tenderNumber"), F.col("id").cast("string")).alias("tender_id"), "title", ward_in_title(F.col("title")).alias("ward_no"), F.col("deptName").alias("department"),
        lakh_of_rupees(F.col("ecv")).alias("value_lakh"), "status", issued.alias("issued_date"), date_dd_mm_yyyy(F.col("tenderClosureDate")).alias("closes"),
    ).where(F.col("issued_date").isNull() | (F.col("issued_date") > mark))


def points(landed: DataFrame) -> DataFrame:
    """Map points; ways count at their centre; missing or zero coordinates are dropped."""
    return landed.select("category", F.coalesce("lat", F.col("center.lat")).alias("lat"), F.coalesce("lon", F.col("center.lon")).alias("lon")).where("coalesce(lat, 0) <> 0 AND coalesce(lon, 0) <> 0")


def features(spark: SparkSession, path: str, id_property: str) -> DataFrame:
    """GeoJSON polygons as (id, ring): the outer ring, of a multipolygon that of its first polygon; null geometry is dropped."""
    schema = f"features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    each = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).where("f.geometry.type IS NOT NULL")
    outer = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")[0][0]).otherwise(F.from_json("f.geometry.coordinates", "array<array<array<double>>>")[0])
    ring = F.transform(outer, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return each.select(F.col("f.properties")[id_property].alias("id"), ring.alias("ring"))


def sanctions(landed: DataFrame) -> DataFrame:
    """Listed names: the caption or the first name, and the joined data sets as the source."""
    return landed.select(F.coalesce("caption", F.get("names", F.lit(0))).alias("listed_name"), F.concat_ws(", ", "datasets").alias("source")).where("listed_name IS NOT NULL")


def landed_or(spark: SparkSession, cached: str, fetch) -> DataFrame:
    """The cached copy if there is one, else what `fetch` gives, which is cached."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cached)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.parquet(cached)
    fetch().write.parquet(cached)
    return spark.read.parquet(cached)


def affidavits(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """A local array of JSON objects that may begin with a byte order mark; every field may be missing."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\uFEFF", "").alias("value"))
    schema = "array<struct<" + ", ".join(f"`{n}`: {kind}" for n, kind in fields.items()) + ">>"
    return whole.select(F.explode(F.from_json("value", schema)).alias("row")).select("row.*")


def listing_children(landed: DataFrame, most: int = 5) -> DataFrame:
    """Posts of a listing ({data: {children: [{data: post}]}}), the first few of each answer, one row each."""
    return landed.select("*", F.explode(F.slice("data.children", 1, most)).alias("_child")).select(*(c for c in landed.columns if c != "data"), "_child.data.*")


def topology_features(landed: DataFrame, layer: str, id_property: str, kinds: list[str] | None = None) -> DataFrame:
    """TopoJSON as (id, ring): arcs are delta-coded integers, scaled and moved; a negative index is an arc read backwards.

    The outer ring counts, of a multipolygon that of its first polygon. Features of other kinds and those without a
    geometry are dropped. `geometries` of a layer have `arcs` as text, since their depth depends on the type.
    """
    scale, move = F.col("transform.scale"), F.col("transform.translate")

    def placed(arc: Column) -> Column:
        start = F.struct(F.array().cast("array<struct<lon: double, lat: double>>").alias("path"), F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"))

        def step(state: Column, point: Column) -> Column:
            x, y = state["x"] + point[0], state["y"] + point[1]
            at = F.struct((x * scale[0] + move[0]).alias("lon"), (y * scale[1] + move[1]).alias("lat"))
            return F.struct(F.concat(state["path"], F.array(at)).alias("path"), x.alias("x"), y.alias("y"))

        return F.aggregate(arc, start, step)["path"]

    arcs = landed.select("objects", F.transform("arcs", placed).alias("paths"))
    each = arcs.select("paths", F.explode(F.col("objects")[layer]["geometries"]).alias("g")).where("g.type IS NOT NULL")
    if kinds:
        each = each.where(F.col("g.properties")[id_property].isin(*kinds))
    outer = F.when(F.col("g.type") == "MultiPolygon", F.from_json("g.arcs", "array<array<array<int>>>")[0][0]).otherwise(F.from_json("g.arcs", "array<array<int>>")[0])
    path = lambda i: F.when(i >= 0, F.get("paths", i)).otherwise(F.reverse(F.get("paths", -i - 1)))
    # Arcs meet in a point that both have: it counts once.
    ring = F.flatten(F.transform(outer, lambda i, k: F.when(k == 0, path(i)).otherwise(F.slice(path(i), F.lit(2), F.greatest(F.size(path(i)) - 1, F.lit(0))))))
    return each.select(F.col("g.properties")[id_property].alias("id"), ring.alias("ring"))


def ward_of_code(code: Column, wards: int = 200) -> Column:
    """Ward number in the last three digits of a numeric code; null outside 1 to `wards` and for codes that aren't numbers."""
    number = F.when(code.rlike(r"^\d+$"), F.pmod(code.try_cast("bigint"), F.lit(1000)))
    return F.when(number.between(1, wards), number).cast("int")


def ward_code_counts(landed: DataFrame, code: str = "code") -> DataFrame:
    """Features per ward, told by their codes."""
    return landed.select(ward_of_code(F.col(code)).alias("ward_no")).where("ward_no IS NOT NULL").groupBy("ward_no").agg(F.count("*").alias("n"))


def high_water_mark(known: DataFrame, issued: str, default: str = "2020-01-01") -> Column:
    """The latest date that is there, as a literal; the default for an empty table."""
    return F.lit(known.agg(F.coalesce(F.max(F.col(issued).cast("date")), F.lit(default).cast("date"))).first()[0])


def has_news(source: DataFrame, known: DataFrame, total: str) -> bool:
    """Whether a source has more rows than the total that is known; an unknown or empty total always loads."""
    existing = known.agg(F.coalesce(F.sum(total), F.lit(0)).cast("bigint")).first()[0]
    return existing == 0 or source.count() > existing


def literal_list(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """Listed names kept by hand (name, source)."""
    return spark.createDataFrame(rows, "listed_name string, source string")
