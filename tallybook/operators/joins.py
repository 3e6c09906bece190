"""Lookups and enrichment joins. Dimensions are small here, but only Spark's size check broadcasts them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.text import letter_runs
from tallybook.operators.dedup import keep_first, keep_last


def same_text(c: Column) -> Column:
    return F.lower(F.trim(c))


def left_lookup(df: DataFrame, right: DataFrame, keys: dict[str, str], ordinal: list[str], nest: str | None = None) -> DataFrame:
    """Left join on text keys compared without case; of repeated right keys the last by ordinal counts."""
    right_keys = list(keys.values())
    one = keep_last(right.withColumns({f"_k_{c}": same_text(F.col(c).cast("string")) for c in right_keys}), [f"_k_{c}" for c in right_keys], ordinal)
    values = [c for c in right.columns if c not in right_keys]
    picked = one.select(*(f"_k_{c}" for c in right_keys), *([F.struct(*values).alias(nest)] if nest else values))
    condition = reduce(lambda a, b: a & b, [same_text(F.col(l).cast("string")) == F.col(f"_k_{r}") for l, r in keys.items()])
    return df.join(picked, condition, "left").drop(*(f"_k_{c}" for c in right_keys))


def star(spine: DataFrame, facts: list[tuple[DataFrame, str]]) -> DataFrame:
    """A spine left-joined with one table per metric, each unique on its key."""
    return reduce(lambda df, fact: df.join(fact[0], fact[1], "left"), facts, spine)


def by_number_else_name(spine: DataFrame, fact: DataFrame, number: str, name: str, values: list[str]) -> DataFrame:
    """Values joined by number, and by trimmed lower-case name where the number finds none."""
    numbered = fact.where(F.col(number).isNotNull()).select(F.col(number).alias("_n"), *(F.col(v).alias(f"_n_{v}") for v in values))
    named = keep_first(fact.withColumn("_name", same_text(F.col(name))), ["_name"], [number]).select("_name", *(F.col(v).alias(f"_m_{v}") for v in values))
    joined = spine.join(numbered, F.col(number) == F.col("_n"), "left").join(named, same_text(F.col(name)) == F.col("_name"), "left")
    return joined.select(*spine.columns, *(F.when(F.col("_n").isNotNull(), F.col(f"_n_{v}")).otherwise(F.col(f"_m_{v}")).alias(v) for v in values))


def compare_by_name(names: DataFrame, spine: DataFrame, name: str, key: str) -> DataFrame:
    """For each asked name the first spine row (by key) whose name contains it, whatever the case, and whether there is one.

    An asked name meets the spine's names in an equi-join on its first three letters; a blank one finds nothing.
    """
    asked = names.select("asked").distinct().where(F.trim("asked") != "").withColumn("_run", F.substring(F.lower("asked"), 1, 3))
    runs = spine.select("*", F.explode(letter_runs(F.lower(F.col(name)), 1, 3)).alias("_run"))
    met = asked.join(runs, "_run").where(F.contains(F.lower(F.col(name)), F.lower("asked")))
    first = met.groupBy("asked").agg(F.min_by(F.struct(*spine.columns), F.col(key)).alias("_hit")).select(F.col("asked").alias("_asked"), *(F.col(f"_hit.{c}").alias(c) for c in spine.columns))
    return names.join(first, F.col("asked") == F.col("_asked"), "left").drop("_asked").withColumn("found", F.col(key).isNotNull())


def canonical(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace a name by its canonical form, if the alias table (alias, canonical) has it."""
    known = aliases.select(same_text(F.col("alias")).alias("_alias"), F.col("canonical").alias("_canonical"))
    joined = df.join(known, same_text(F.col(column)) == F.col("_alias"), "left")
    return joined.withColumn(column, F.coalesce("_canonical", column)).drop("_alias", "_canonical")


def update_from(df: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Set columns from a table unique on the keys, where it has a value."""
    new = updates.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = df.join(new, keys, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*(f"_new_{c}" for c in columns)).select(df.columns)


def update_by_prefix_else_word(df: DataFrame, updates: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Set columns from rows whose name starts with the update's name, else holds its last word; first by name.

    Names meet updates in an equi-join on runs of up to three letters: an update's last word begins with one that the
    name holds, and so does an update's name that the name starts with. Rows are found again by their name, so repeated
    rows all stay.
    """
    new = updates.select(F.lower(F.trim(name)).alias("_u_name"), *(F.col(c).alias(f"_u_{c}") for c in columns)).where(F.length("_u_name") > 0)
    word = F.element_at(F.split("_u_name", " "), -1)
    starts = F.explode(F.array_distinct(F.array(F.substring("_u_name", 1, 3), F.substring(word, 1, 3))))
    asked = new.select("*", word.alias("_word"), starts.alias("_run"))
    names = df.select(F.lower(name).alias("_name")).where(F.length("_name") > 0).distinct()
    runs = names.select("_name", F.explode(letter_runs(F.col("_name"), 1, 3)).alias("_run"))
    fit = F.when(F.startswith("_name", "_u_name"), 0).when(F.contains("_name", "_word"), 1)
    best = runs.join(asked, "_run").withColumn("_fit", fit).where("_fit IS NOT NULL").groupBy("_name").agg(F.min_by(F.struct(*(f"_u_{c}" for c in columns)), F.struct("_fit", "_u_name")).alias("_best"))
    joined = df.join(best, F.lower(F.col(name)) == F.col("_name"), "left")
    return joined.select(*(F.coalesce(f"_best._u_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns))


def chained(df: DataFrame, hops: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Follow lookups one after another (table, its key, the column here that holds it); a missing hop leaves nulls behind it."""
    for table, key, column in hops:
        there = table.select(F.col(key).alias("_hop"), *(c for c in table.columns if c != key))
        df = df.join(there, F.col(column) == F.col("_hop"), "left").drop("_hop")
    return df


def linked_if_there(df: DataFrame, key: str, pages: DataFrame, page_key: str, link: Column) -> DataFrame:
    """Add `link` to rows whose key has a page, null to the others."""
    known = pages.select(F.col(page_key).alias("_page")).distinct()
    return df.join(known, F.col(key) == F.col("_page"), "left").withColumn("link", F.when(F.col("_page").isNotNull(), link)).drop("_page")


def not_yet(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those already done: votes cast, facts known."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def with_any_first_word(df: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """Rows that hold the first word of one of the names, as one of their own words: an equi-join on words."""
    firsts = names.select(F.lower(F.element_at(F.split(F.trim(name), " "), 1)).alias("_word")).where("_word <> ''").distinct()
    keyed = df.withColumn("_id", F.xxhash64(*df.columns))
    words = keyed.select("_id", F.explode(F.array_distinct(F.split(F.lower(F.col(column)), r"\s+"))).alias("_word"))
    hits = words.join(firsts, "_word", "left_semi").select("_id").distinct()
    return keyed.join(hits, "_id", "left_semi").drop("_id")
