"""A ward's profile: the people who answer for it, its tenders, the alert that holds and what is known of it, nested and bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.operators.ranking import top_per_group

#: Entries of each list; totals count all.
MOST = 10


def first_entries(rows: DataFrame, key: str, order: list[Column], columns: list[str], name: str, most: int = MOST) -> DataFrame:
    """key and a list of the first entries in order. Spark drops what is beyond within tasks, so a large group is never gathered."""
    entry = F.struct("_place", *columns)
    kept = top_per_group(rows, [key], order, most, "_place").groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias(name))
    fields = lambda e: F.struct(*(e[c].alias(c) for c in columns))
    return kept.withColumn(name, F.transform(name, fields))


def trust(source_type: Column, corroborations: Column, disputes: Column) -> Column:
    """Official and RTI sources count as such; else disputes that reach the corroborations, then five corroborations, decide."""
    return (
        F.when(source_type.isin("official", "rti"), source_type)
        .when((disputes > 0) & (disputes >= corroborations), "disputed")
        .when(corroborations >= 5, "community_verified")
        .otherwise("unverified")
    )


def ward_profiles(wards: DataFrame, reps: DataFrame, officers: DataFrame, tenders: DataFrame, alerts: DataFrame, facts: DataFrame, most: int = MOST) -> DataFrame:
    """ward_no, assembly_constituency, elected_reps, officers, tenders, tender_count, tender_total_lakh, governance_alert, community_facts.

    wards: ward_no, assembly_constituency. reps: assembly_constituency, role, name. officers: ward_no, role, name. tenders: ward_no,
    tender_id, title, value_lakh, issued_date. alerts: ward_no (null: all wards), title, since. facts: ward_no, id, subject, value,
    source_type, corroboration_count, dispute_count, is_active. Lists are empty where there is nothing; the latest alert holds, a ward's
    own before one of all wards.
    """
    lists = {
        "elected_reps": (first_entries(reps, "assembly_constituency", [F.asc("role"), F.asc("name")], ["role", "name"], "elected_reps", most), "assembly_constituency"),
        "officers": (first_entries(officers, "ward_no", [F.asc("role"), F.asc("name")], ["role", "name"], "officers", most), "ward_no"),
        "tenders": (first_entries(tenders, "ward_no", [F.desc_nulls_last("issued_date"), F.asc("tender_id")], ["tender_id", "title", "value_lakh", "issued_date"], "tenders", most), "ward_no"),
    }
    told = facts.where("is_active").withColumn("trust_level", trust(F.col("source_type"), F.col("corroboration_count"), F.col("dispute_count")))
    lists["community_facts"] = (first_entries(told, "ward_no", [F.desc("corroboration_count"), F.asc("id")], ["id", "subject", "value", "trust_level"], "community_facts", most), "ward_no")
    profile = wards
    for name, (listed, key) in lists.items():
        profile = profile.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    totals = tenders.groupBy("ward_no").agg(F.count("*").alias("tender_count"), F.sum(F.col("value_lakh").cast("decimal(18,2)")).cast("double").alias("tender_total_lakh"))
    latest = F.max_by(F.struct("title", "since"), F.struct("since", "title"))
    own = alerts.where("ward_no IS NOT NULL").groupBy("ward_no").agg(latest.alias("_own"))
    common = alerts.where("ward_no IS NULL").agg(latest.alias("_common"))  # one row
    profile = profile.join(totals, "ward_no", "left").join(own, "ward_no", "left").join(F.broadcast(common))
    return profile.select(
        "ward_no", "assembly_constituency", "elected_reps", "officers", "tenders", F.coalesce("tender_count", F.lit(0)).alias("tender_count"), F.coalesce("tender_total_lakh", F.lit(0.0)).alias("tender_total_lakh"),
        F.coalesce("_own", "_common").alias("governance_alert"), "community_facts",
    )
