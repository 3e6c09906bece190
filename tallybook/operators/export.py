"""Sinks for the public: wide CSV, JSON envelope, Markdown pages, cached JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import csv_field


def csv_lines(df: DataFrame) -> DataFrame:
    """One CSV line per row, quoted only where needed, null empty."""
    return df.select(F.array_join(F.array(*(csv_field(F.col(c)) for c in df.columns)), ",").alias("line"))


def csv_header(df: DataFrame) -> str:
    return ",".join(df.columns)


def csv_document(df: DataFrame, footer: list[str]) -> DataFrame:
    """Parts of a CSV document (part 0: the header, 1: a line per row, 2: the attribution, line by line); without rows one line that says so."""
    spark = df.sparkSession
    if df.isEmpty():
        return spark.createDataFrame([(0, "No data available")], "part int, line string")
    frame = spark.createDataFrame([(0, csv_header(df))] + [(2, csv_quoted(x)) for x in ["", "# DATA SOURCES & ATTRIBUTION", *footer]], "part int, line string")
    return frame.unionByName(csv_lines(df).select(F.lit(1).alias("part"), "line"))


def csv_quoted(line: str) -> str:
    """An attribution line as one field."""
    return '"' + line.replace('"', '""') + '"' if any(c in line for c in ',"\n') else line


def json_envelope(df: DataFrame, source: str, license_name: str, limit: int) -> DataFrame:
    """One row `{data, count, source, license}` for an API page of at most `limit` rows."""
    page = df.limit(limit)
    return page.agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias("data"), F.count("*").alias("count"), F.lit(source).alias("source"), F.lit(license_name).alias("license"))).alias("body"))


def markdown_pages(df: DataFrame, key: str, title: str, columns: list[str]) -> DataFrame:
    """A page per key: its title and a table with one line per row, made where the rows are."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    rows = df.select(key, title, F.struct("rank", line.alias("line")).alias("row"))
    grouped = rows.groupBy(key).agg(F.first(title).alias("title"), F.sort_array(F.collect_list("row")).alias("rows"))
    return grouped.select(key, F.concat(F.lit("# "), F.col("title"), F.lit("\n\n" + head), F.array_join(F.col("rows.line"), "\n"), F.lit("\n")).alias("page"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, replacing what is there: lists and aggregates kept beside the tables."""
    df.write.mode("overwrite").json(path)


def index_page(pages: DataFrame, title: str, group: str, key: str, name: str) -> DataFrame:
    """One section per group, its keys in order with links to their pages: rows (group, section), bounded by the pages of a group."""
    entry = F.struct(F.col(key).alias("k"), F.concat(F.lit("| "), F.col(key), F.lit(" | ["), F.col(name), F.lit("](ward-"), F.col(key), F.lit(".md) |")).alias("line"))
    head = f"# {title}\n\n## "
    section = F.concat(F.lit(head), F.coalesce(group, F.lit("Unassigned")), F.lit("\n"), F.array_join(F.sort_array(F.collect_list(entry))["line"], "\n"))
    return pages.groupBy(F.coalesce(group, F.lit("Unassigned")).alias(group)).agg(section.alias("section"))


def write_pages(pages: DataFrame, path: str, key: str, page: str) -> None:
    """A folder per key with its page as text; pages of an earlier run are gone."""
    pages.select(F.col(key).cast("string").alias(key), F.col(page).alias("value")).write.mode("overwrite").partitionBy(key).text(path)
