"""Place names found in texts: every alias that a text contains, without a nested loop of texts and aliases.

A gazetteer whose aliases are counted to be few bytes is sent to the tasks as one automaton (Aho-Corasick): a text is read
once, however many aliases there are, and only (text, alias) hits leave the task. A larger one meets the texts in an
equi-join on letter runs: each alias waits under its rarest run, a text looks up its distinct runs, and what meets is held
against the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallybook.session import written

#: Aliases of so many bytes together are sent as an automaton (some hundred bytes a letter when built).
AUTOMATON_BYTES = 1 << 20
#: Texts of a batch that are looked through at once, so that memory doesn't follow the rows of a task.
SLICE = 128
#: Length of the letter runs that a larger gazetteer is joined on.
RUN = 3


def mentions(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """key, alias: the aliases (lower-case, of `names`) that each lower-cased text contains, each once."""
    aliases = names.select("alias").where("alias <> ''").distinct()
    lowered = texts.select(key, F.lower(text).alias("_text")).where("_text IS NOT NULL")
    if aliases.agg(F.coalesce(F.sum(F.octet_length("alias")), F.lit(0))).first()[0] <= AUTOMATON_BYTES:
        return _by_automaton(lowered, [r[0] for r in aliases.collect()], key)
    return _by_runs(lowered, aliases, key)


def _by_automaton(lowered: DataFrame, aliases: list[str], key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for alias in aliases:
            found.add_word(alias, alias)
        found.make_automaton()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                keys, texts = batch.slice(start, SLICE).columns
                places, hits = [], []
                for n, text in enumerate(texts.to_pylist() if aliases else ()):
                    held = {alias for _, alias in found.iter(text)}
                    places += [n] * len(held)
                    hits += held
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(places, pa.int64())), pa.array(hits, pa.string())], [key, "alias"])
        pa.default_memory_pool().release_unused()

    return lowered.mapInArrow(run, StructType([lowered.schema[key], StructField("alias", StringType())]))


def _runs(text: Column, length: int) -> Column:
    """The distinct letter runs of one length; none for shorter texts."""
    last = F.length(text) - length + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(length)))))


def _by_runs(lowered: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    own = aliases.select("alias", F.explode(F.coalesce(_runs(F.col("alias"), RUN), F.array("alias"))).alias("run"))
    often = own.groupBy("run").agg(F.count("*").alias("n"))
    rarest = written(own.join(often, "run").groupBy("alias").agg(F.min_by("run", F.struct("n", "run")).alias("run")))
    lengths = range(1, RUN + 1)  # aliases shorter than a run are runs themselves
    looked = lowered.select(key, F.explode(F.flatten(F.array(*(F.coalesce(_runs(F.col("_text"), n), F.array().cast("array<string>")) for n in lengths)))).alias("run"))
    met = looked.join(rarest, "run").select(key, "alias")
    return met.join(lowered, key).where(F.contains("_text", F.col("alias"))).select(key, "alias").distinct()


def place_hits(texts: DataFrame, names: DataFrame, key: str, *columns: str, rule: str = "declared") -> DataFrame:
    """key, place, alias, ordinal, field: every place mentioned, once for each text.

    names: alias, place, ordinal. Of several aliases of a place one names it: under the rule `declared` the first of the
    gazetteer, under `longest` the longest (the first of equals). Fields are looked at in their order: a place that an earlier one
    mentions is named by it (a hint before a title).
    """
    hits = None
    for field, column in enumerate(columns):
        told = mentions(texts, names, key, column).withColumn("field", F.lit(field))
        hits = told if hits is None else hits.unionAll(told)
    order = [F.col("field"), *([F.length("alias") * -1] if rule == "longest" else []), F.col("ordinal"), F.col("alias")]
    first = F.min_by(F.struct("alias", "ordinal", "field"), F.struct(*order))
    return hits.join(names, "alias").groupBy(key, "place").agg(first.alias("_f")).select(key, "place", "_f.alias", "_f.ordinal", "_f.field")


def first_place(hits: DataFrame, key: str) -> DataFrame:
    """The one place of each text that comes first: by field, then in the gazetteer's order."""
    best = F.min_by(F.struct("place", "alias"), F.struct("field", "ordinal", "place"))
    return hits.groupBy(key).agg(best.alias("_f")).select(key, "_f.place", "_f.alias")


def places_in_order(hits: DataFrame, key: str) -> DataFrame:
    """key, places: those of the hint first, each field's in the gazetteer's order."""
    return hits.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("field", "ordinal", "place"))), lambda h: h["place"]).alias("places"))


def outermost(hits: DataFrame, key: str) -> DataFrame:
    """Hits whose alias lies in no longer alias that the same text hits: `north park street` hides `north park`."""
    longer = hits.select(F.col(key).alias("_key"), F.col("alias").alias("_longer"), "field")
    inside = hits.join(longer.withColumnRenamed("field", "_field"), (F.col(key) == F.col("_key")) & (F.col("field") == F.col("_field")) & (F.length("_longer") > F.length("alias")) & F.contains("_longer", F.col("alias")), "left_anti")
    return inside
