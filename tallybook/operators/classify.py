"""Keyword classification, gazetteer fan-out, and the state machine of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which agency answers for an issue, by the city's configuration.
ISSUE_AGENCIES = {
    "pothole": "roads_local", "road_repair": "roads_local", "footpath": "roads_local", "streetlight": "roads_local", "garbage": "roads_local",
    "park": "roads_local", "drain_stormwater": "roads_local", "water_supply": "water", "sewage": "water", "electricity": "electricity",
    "traffic_signal": "traffic", "road_arterial": "roads_arterial",
}


def keyword_score(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords a lower-cased text contains."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(F.contains(lowered, F.lit(k.lower())), 1).otherwise(0) for k in keywords), F.lit(0))


def keyword_category(text: Column, categories: dict[str, list[str]]) -> Column:
    """The category with most keywords in the text; the first listed of equals; null without a hit.

    The dictionary is a parameter: feeds and batch runs use different ones.
    """
    scores = F.array(*(F.struct(keyword_score(text, words).alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("category")) for k, (name, words) in enumerate(categories.items())))
    best = F.array_max(scores)
    return F.when(best["score"] > 0, best["category"])


def gazetteer(spark: SparkSession, entries: list[tuple[str, int]]) -> DataFrame:
    """alias, place, ordinal: a place-name dictionary in the order it is declared."""
    return spark.createDataFrame([(a.lower(), p, k) for k, (a, p) in enumerate(entries)], "alias string, place int, ordinal int")


def one_row_per_place(signals: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Fan a signal out to each of its places; a signal without any keeps one row with null."""
    return signals.join(hits.select(key, "place", "alias"), key, "left")


def agency(issue: Column) -> Column:
    pairs = [x for k, v in ISSUE_AGENCIES.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), issue)


# Which authority answers for a type of report.
REPORT_AUTHORITIES = {
    "hoarding": "BBMP", "pothole": "BBMP", "flooding": "BBMP", "construction": "BBMP", "encroachment": "BBMP", "garbage": "BBMP", "signal": "BTP", "other": "BBMP",
}


def authority(report_type: Column) -> Column:
    """The authority of a report's type; null for unknown types."""
    pairs = [x for k, v in REPORT_AUTHORITIES.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), report_type)


def moderation_status(text_flagged: Column, has_photo: Column, photo_civic: Column, confidence: Column) -> Column:
    """Flagged text is rejected; a photo decides by what it shows and how sure that is; text alone is approved."""
    return (
        F.when(text_flagged, "rejected")
        .when(has_photo & (~photo_civic | (confidence < 40)), "rejected")
        .when(has_photo & (confidence >= 70), "approved")
        .when(has_photo, "pending")
        .otherwise("approved")
    )
