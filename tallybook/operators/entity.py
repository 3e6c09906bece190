"""Entity resolution: vendor profiles from work orders, and fuzzy matching against a debarment list."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import entity_key, letter_runs, name_tokens, rounded
from tallybook.operators.merge import partial_upsert
from tallybook.session import written


def work_facts(lineitem: DataFrame, orders: DataFrame, supplier: DataFrame, customer: DataFrame) -> DataFrame:
    """Work orders: one row per line item with its vendor's name as written and phone, ward, year and amounts.

    The tables have one spelling of a name; every fourth line has it in capitals, every fourth with a suffix, and one
    vendor in three has no phone.
    """
    sanctioned = F.col("l_extendedprice").cast("decimal(18,2)")
    deduction = (sanctioned * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,4)")
    name = F.when(F.col("l_linenumber") % 4 == 0, F.upper("s_name")).when(F.col("l_linenumber") % 4 == 1, F.concat("s_name", F.lit(" Pvt Ltd"))).otherwise(F.col("s_name"))
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            name.alias("vendor_name"),
            F.when(F.col("l_suppkey") % 3 != 0, F.lpad(F.col("l_suppkey").cast("string"), 10, "9")).alias("phone"),
            F.col("c_nationkey").alias("ward_no"),
            F.year("o_orderdate").cast("string").alias("fy"),
            sanctioned.alias("sanctioned"),
            (sanctioned - deduction).cast("decimal(18,4)").alias("net_paid"),
            deduction.alias("deduction"),
        )
    )


def any_like(name: Column, patterns: Iterable[str]) -> Column:
    """True where the name matches one of the LIKE patterns."""
    return reduce(lambda a, b: a | b, [name.like(p) for p in patterns], F.lit(False))


def lakh(amount: Column) -> Column:
    """Rupees to lakh with two decimals."""
    return rounded(amount.cast("double") / F.lit(1e5), 2)


def vendor_profiles(facts: DataFrame, government_patterns: Iterable[str]) -> DataFrame:
    """Group work orders into vendor profiles by phone, else by trimmed lower-case name; rows without a name don't count.

    The most frequent spelling is the profile's name (the first by letters if several are), all are its aliases. Sums
    are decimal, so they don't depend on row order.
    """
    sanctioned, deduction = F.sum("sanctioned"), F.sum("deduction")
    named = facts.where(F.col("vendor_name").isNotNull()).withColumn("key", F.coalesce("phone", F.lower(F.trim("vendor_name"))))
    return (
        named.groupBy(F.when(F.col("phone").isNotNull(), F.concat(F.lit("ph_"), "phone")).otherwise(F.concat(F.lit("nm_"), "key")).alias("entity_id"), "phone")
        .agg(
            F.mode("vendor_name", deterministic=True).alias("canonical_name"),
            F.sort_array(F.collect_set("vendor_name")).alias("aliases"),
            F.count("*").alias("total_contracts"),
            lakh(sanctioned).alias("total_value_lakh"),
            lakh(F.sum("net_paid")).alias("total_paid_lakh"),
            lakh(deduction).alias("total_deduction_lakh"),
            F.when(sanctioned > 0, rounded(F.lit(100) * deduction.cast("double") / sanctioned.cast("double"), 2)).otherwise(0.0).alias("avg_deduction_pct"),
            F.sort_array(F.collect_set("ward_no")).alias("wards"),
            F.min("fy").alias("first_seen"),
            F.max("fy").alias("last_seen"),
            F.bool_or(any_like(F.upper("vendor_name"), government_patterns)).alias("is_govt_entity"),
        )
        .select("*", F.size("wards").cast("bigint").alias("ward_count"))
    )


#: What a later run sets in a profile that is there already; its phone stays.
REFRESHED = (
    "canonical_name", "aliases", "total_contracts", "total_value_lakh", "total_paid_lakh", "total_deduction_lakh", "avg_deduction_pct",
    "wards", "ward_count", "first_seen", "last_seen", "is_govt_entity",
)


def refreshed_profiles(existing: DataFrame, facts: DataFrame, government_patterns: Iterable[str]) -> DataFrame:
    """Profiles of the facts merged into those there are: known vendors are refreshed, unknown ones added, others stay."""
    return partial_upsert(existing, vendor_profiles(facts, government_patterns), ["entity_id"], list(REFRESHED))


def _rarest(keyed: DataFrame, key: str, item: str, counts: DataFrame) -> DataFrame:
    """(key, item): the rarest item of each key."""
    return keyed.join(counts, item).groupBy(key).agg(F.min(F.struct("held", item)).alias("x")).select(key, F.col(f"x.{item}").alias(item))


def _prefixes(keyed: DataFrame, key: str, counts: DataFrame, share: float) -> DataFrame:
    """(key, items, prefix, token): each key's tokens by rarity, and those of which sets that overlap by `share` have one in common, a row for each."""
    ordered = keyed.join(counts, "token").groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("held", "token"))), lambda x: x["token"]).alias("items"))
    taken = F.size("items") - F.ceil(F.lit(share) * F.size("items") - 1e-9).cast("int") + 1
    return ordered.withColumn("prefix", F.slice("items", F.lit(1), taken)).select("*", F.explode("prefix").alias("token"))


#: Pieces of a token's keys that are held against its listed keys in different tasks.
PIECES = 16


def _token_pairs(left: DataFrame, right: DataFrame, share: float) -> DataFrame:
    """key, listed_key, rule, distance: pairs of token sets (of `_prefixes`) that overlap by `share`, each once.

    Few tokens may be in most keys, so keys of one token are dealt over pieces, and what meets is settled where it meets: a
    pair counts at the first token that its prefixes share, so no table of candidates is made.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("piece", F.pmod(F.hash("key"), F.lit(PIECES))).repartition(n, "token", "piece")
    copied = right.select("listed_key", F.col("items").alias("listed_items"), F.col("prefix").alias("listed_prefix"), "token", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("piece"))
    smaller, larger = F.least(F.size("items"), F.size("listed_items")), F.greatest(F.size("items"), F.size("listed_items"))
    first = F.get(F.array_intersect("prefix", "listed_prefix"), F.lit(0)) == F.col("token")
    met = dealt.join(copied.repartition(n, "token", "piece"), ["token", "piece"]).where((smaller >= share * larger - 1e-9) & first)
    both = F.size(F.array_intersect("items", "listed_items"))
    near = both / (F.size("items") + F.size("listed_items") - both)
    return met.where(near >= share - 1e-9).select("key", "listed_key", F.lit(1).alias("rule"), (1.0 - near).alias("distance"))


def _held_short(short: DataFrame, short_key: str, long: DataFrame, long_key: str) -> DataFrame:
    """Pairs where a key of one or two letters is in another: an equi-join on runs of that length."""
    runs = long.select(long_key, F.explode(letter_runs(F.col(long_key), 1, 2)).alias("run"))
    return short.where(F.length(short_key) < 3).join(runs, F.col(short_key) == F.col("run")).select("key", "listed_key")


def fuzzy_matches(names: DataFrame, listed: DataFrame, threshold: float = 0.4, min_length: int = 1) -> DataFrame:
    """Debarment matches: names (entity_id, name) against a list (listed_name, source), with their distance.

    Distance 0 for equal keys, 0.1 if one key contains the other, else 1 less the Jaccard similarity of the tokens.
    Candidates are blocked without losing any, all by equi-joins: a contained key's rarest three-letter run is in the
    other key, a shorter key is one of the other's runs, and token sets within the threshold share a token of their
    prefixes under rarity. All this is done once for each spelling; the names themselves meet the result last, so rows that are
    many for one spelling are neither keyed nor sorted more than once.
    """
    spelled = written(names.select("name").distinct().withColumn("key", entity_key(F.col("name"))).where((F.length("key") >= min_length) & (F.col("key") != "")))
    right = listed.select("listed_name", "source", entity_key(F.col("listed_name")).alias("listed_key")).where((F.length("listed_key") >= min_length) & (F.col("listed_key") != ""))
    keys, listed_keys = written(spelled.select("key").distinct()), written(right.select("listed_key").distinct())

    def exploded(df: DataFrame, c: str, item: str, items: Column) -> DataFrame:
        return df.select(c, F.explode(items).alias(item))

    a, b = exploded(keys, "key", "gram", letter_runs(F.col("key"), 3, 3)), exploded(listed_keys, "listed_key", "gram", letter_runs(F.col("listed_key"), 3, 3))
    held = a.select("gram").unionAll(b.select("gram")).groupBy("gram").agg(F.count("*").alias("held"))
    s, t = exploded(keys, "key", "token", name_tokens(F.col("key"))), exploded(listed_keys, "listed_key", "token", name_tokens(F.col("listed_key")))
    used = written(s.select("token").unionAll(t.select("token")).groupBy("token").agg(F.count("*").alias("held")))

    within = _rarest(b, "listed_key", "gram", held).join(a, "gram").where(F.contains("key", "listed_key"))
    around = _rarest(a, "key", "gram", held).join(b, "gram").where(F.contains("listed_key", "key"))
    contained = within.select("key", "listed_key").unionAll(around.select("key", "listed_key"))
    contained = contained.unionAll(_held_short(keys, "key", listed_keys, "listed_key")).unionAll(_held_short(listed_keys, "listed_key", keys, "key")).distinct()
    near = contained.select("key", "listed_key", F.lit(0).alias("rule"), F.when(F.col("key") == F.col("listed_key"), 0.0).otherwise(0.1).alias("distance"))

    share = 1 - threshold
    alike = _token_pairs(_prefixes(s, "key", used, share), _prefixes(t, "listed_key", used, share), share)

    scored = near.unionAll(alike).groupBy("key", "listed_key").agg(F.min_by("distance", "rule").alias("distance")).where(F.col("distance") <= threshold)
    told = spelled.join(scored, "key").join(right, "listed_key").select("name", "listed_name", "source", "distance")
    return names.select("entity_id", "name").join(told, "name").select("entity_id", "name", "listed_name", "source", "distance")


def alias_matches(profiles: DataFrame, listed: DataFrame, threshold: float = 0.4) -> DataFrame:
    """One match of a profile (entity_id, canonical_name, aliases) and a listed name: that of the first spelling within the threshold."""
    spelled = profiles.select("entity_id", F.posexplode(F.array_distinct(F.concat(F.array("canonical_name"), "aliases"))).alias("place", "name"))
    found = fuzzy_matches(spelled.select(F.struct("entity_id", "place").alias("entity_id"), "name"), listed, threshold)
    best = F.min_by(F.struct("name", "distance"), "entity_id.place").alias("best")
    return found.groupBy(F.col("entity_id.entity_id").alias("entity_id"), "listed_name", "source").agg(best).select("entity_id", F.col("best.name").alias("name"), "listed_name", "source", F.col("best.distance").alias("distance"))


def flags(matches: DataFrame) -> DataFrame:
    """entity_id with the sorted set of sources that list it."""
    return matches.groupBy("entity_id").agg(F.sort_array(F.collect_set("source")).alias("blacklist_flags"))
