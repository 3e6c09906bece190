"""Query op10: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.language_mixture import held_out, identify, train


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and mixture (languages with their percentages, largest first) of every row of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pairs = F.transform(F.map_entries("shares"), lambda x: F.struct((-F.round(x["value"] * 100)).cast("int").alias("share"), x["key"].alias("lang")))
    mixture = F.array_join(F.transform(F.sort_array(pairs), lambda x: F.concat_ws(":", x["lang"], -x["share"])), ",")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", mixture.alias("mixture"))
