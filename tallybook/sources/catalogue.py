"""Portals' catalogues: many CSV files, each under a header of its own, read as one table.

The headers are read first, one line of each file. Files of one layout (the same columns in the same order, whatever the
spelling's case) are one scan; the scans are brought to one set of fields and united. So a plan has as many scans as there are
layouts, not files, and a column never takes another's place. What the driver gets is the name and the header of each file, no more
than Spark's own listing of the files holds.
"""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.text import first_filled, found
from tallybook.sources.records import ORDER_FIELDS, read_csv, strings, work_orders

RESOURCES = "result struct<resources: array<struct<id: string, name: string, url: string, format: string>>>"


def resources(spark: SparkSession, path: str) -> DataFrame:
    """The CSV files of a catalogue: name, url, and ward_no, year and constituency as far as the name tells them."""
    each = spark.read.schema(RESOURCES).option("multiLine", True).json(path).select(F.explode("result.resources").alias("r")).select("r.*")
    name = F.col("name")
    return each.where(F.contains(F.lower("format"), F.lit("csv")) & (F.col("url") != "")).select(
        "name", "url", found(name, r"(?i)ward[- _]?0*(\d+)").try_cast("int").alias("ward_no"),
        found(name, r"\b(202\d)\b").try_cast("int").alias("year"), constituency_of(name).alias("constituency"),
    )


def constituency_of(name: Column) -> Column:
    """`... AC 150 Name (2013-2018)` or `Name Constituency ...`; else null."""
    return F.trim(F.coalesce(found(name, r"AC \d+ (.+?) \("), found(name, r"^(.+?) Constituency\b")))


def last_segments(path: Column, segments: int) -> Column:
    """The last so many segments of a path or url, decoded, without query and fragment."""
    plain = F.split(F.url_decode(F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"\+", "%2B")), "/")
    return F.array_join(F.slice(plain, -F.least(F.size(plain), F.lit(segments)), segments), "/")


def first_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, header: the first line of every file that has one, without its byte order mark; only a file's first block is looked at."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("place"), F.col("_metadata.file_block_start").alias("at"))
    return lines.where("at = 0").groupBy("file").agg(F.regexp_replace(F.min_by("value", "place"), "^\\uFEFF", "").alias("header")).where("trim(header) <> ''")


def read_layouts(spark: SparkSession, path: str | list[str], fields: dict[str, tuple[str, ...]], multi_line: bool = False, quotes: bool = True) -> DataFrame:
    """The fields (name: headers that may hold it, the first filled one counts), `source_file` and `source_path` of all files, as text."""
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file, header in first_lines(spark, path).collect():
        names = next(csv.reader([header], skipinitialspace=True)) if quotes else header.split(",")
        layouts.setdefault(tuple(n.strip().lower() for n in names), []).append(unquote(file))
    scans = []
    for layout, files in sorted(layouts.items()):
        columns = [f"_c{k}" for k in range(len(layout))]
        raw = read_csv(spark, [_plain(f) for f in sorted(files)], multi_line, schema=strings(*columns), quotes=quotes)
        held = {name: dict.fromkeys(c for h in headers for n, c in zip(layout, columns) if n == h.strip().lower()) for name, headers in fields.items()}
        values = (first_filled(*(F.col(c) for c in cs)) if cs else F.lit(None).cast("string") for cs in held.values())
        scans.append(raw.select(*(v.alias(n) for v, n in zip(values, held)), "source_file", F.col("_metadata.file_path").alias("source_path")))
    if not scans:
        return spark.createDataFrame([], strings(*fields, "source_file", "source_path"))
    return reduce(DataFrame.unionAll, scans)


def _plain(file: str) -> str:
    """A file's path with the characters that would make it a pattern marked as plain."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in file)


def with_resource(rows: DataFrame, listed: DataFrame, segments: int = 1) -> DataFrame:
    """Rows with resource_ward, resource_year and resource_constituency of the resource whose url ends as the file's path does; other rows are dropped."""
    told = listed.groupBy(last_segments(F.col("url"), segments).alias("_landed")).agg(*(F.min(c).alias(f"resource_{new}") for c, new in (("ward_no", "ward"), ("year", "year"), ("constituency", "constituency"))))
    return rows.join(told, last_segments(F.col("source_path"), segments) == F.col("_landed")).drop("_landed")


def missing_files(listed: DataFrame, read: DataFrame, segments: int = 1) -> DataFrame:
    """Resources of the catalogue of which no row was read: not landed, or empty."""
    there = read.select(last_segments(F.col("source_path"), segments).alias("_landed")).distinct()
    return listed.join(there, last_segments(F.col("url"), segments) == F.col("_landed"), "left_anti")


def catalogue_work_orders(spark: SparkSession, catalogue: str, folder: str, fiscal_year: str | None = None, multi_line: bool = False, segments: int = 1) -> DataFrame:
    """Work orders of all listed files of a folder, with their resource's year and constituency; the ward is the resource's, else the order's, else the row's."""
    rows = with_resource(read_layouts(spark, folder, ORDER_FIELDS, multi_line), resources(spark, catalogue), segments)
    return work_orders(rows, fiscal_year, "resource_ward", ("resource_year", "resource_constituency"))
