"""One answer for each ward, any of which may be broken: good rows beside error rows, and no ward takes another's down.

An answer is an array of rows, an object {rError: ...} where the portal has none, or no JSON at all (a cut transfer, an error
page). Fields are read as text first and typed after, so that one odd value costs a cell and not the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallybook.functions.text import blank_to_null, coded_name, fiscal_year_of_code, job_fields, labelled_segment, leading_number

# The fields of a payment grid's rows.
GRID_FIELDS = ("wcname", "nameofwork", "amount", "wbid", "jobcode", "brdetails")


def answers(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """source_path, value: every file's whole text."""
    return spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), "value")


def opened(landed: DataFrame, value: str = "value", fields: tuple[str, ...] = GRID_FIELDS) -> DataFrame:
    """The landed rows with `rows` (array of structs of texts; empty where the portal has none) and `error` (null for good answers).

    Errors: `empty`, `not JSON: ...` with the answer's beginning, `portal: ...` with what it says, `no rows: ...` for other JSON.
    """
    text = F.trim(F.regexp_replace(F.coalesce(F.col(value), F.lit("")), "^\\uFEFF", ""))
    row = "struct<" + ", ".join(f"`{f}`: string" for f in fields) + ">"
    # An answer that is JSON becomes a variant whatever it holds; a cut or broken one gives null.
    parsed = F.try_parse_json(text)
    listed = F.when(parsed.isNotNull() & F.startswith(text, F.lit("[")), F.from_json(text, f"array<{row}>"))
    said = F.get_json_object(text, "$.rError")
    error = (
        F.when(text == "", "empty")
        .when(parsed.isNull(), F.concat(F.lit("not JSON: "), F.substring(text, 1, 60)))
        .when(said.isNotNull(), F.concat(F.lit("portal: "), said))
        .when(listed.isNull(), F.concat(F.lit("no rows: "), F.substring(text, 1, 60)))
    )
    none = F.array().cast(f"array<{row}>")
    return landed.withColumns({"error": error, "rows": F.coalesce(F.filter(listed, lambda r: r.isNotNull()), none)})


def payments(answered: DataFrame, *keep: str) -> DataFrame:
    """Typed rows of good answers: order, description, vendor's code and name, amount, stages. Rows without an order are dropped.

    `odd` names the fields whose text can't be read as what they are; they are null.
    """
    r = answered.select(*keep, F.explode("rows").alias("r")).select(*keep, "r.*")
    job, amount, bill = job_fields(F.col("jobcode")), leading_number(F.col("amount")), F.col("wbid").try_cast("bigint")
    vendor = coded_name(job["contractor_raw"])
    odd = F.filter(F.array(_odd("amount", amount), _odd("wbid", bill)), lambda c: c.isNotNull())
    return r.select(
        *keep, blank_to_null(F.col("wcname")).alias("work_order_id"), F.substring(F.trim("nameofwork"), 1, 500).alias("description"), vendor["code"].alias("contractor_code"), vendor["name"].alias("contractor_name"),
        amount.cast("decimal(18,2)").alias("sanctioned_amount"), fiscal_year_of_code(F.col("wcname")).alias("fy"), job["division"].alias("division"), job["start_date"].alias("start_date"),
        labelled_segment(F.col("brdetails"), "BR").alias("bill_ref"), bill.alias("bill_no"), F.array_join(odd, ",").alias("odd"),
    ).where("work_order_id IS NOT NULL")


def _odd(name: str, typed: Column) -> Column:
    return F.when(blank_to_null(F.col(name)).isNotNull() & typed.isNull(), name)


def typed_or_error(rows: DataFrame, schema: StructType) -> DataFrame:
    """Text columns cast to the schema's types, with `errors`: the columns that have a text which is none of their type."""
    casts = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema.fields}
    errors = F.filter(F.array(*(F.when(blank_to_null(F.col(f"`{n}`")).isNotNull() & c.isNull(), n) for n, c in casts.items())), lambda c: c.isNotNull())
    others = [c for c in rows.columns if c not in casts]
    return rows.select(*others, *(c.alias(n) for n, c in casts.items()), errors.alias("errors"))
