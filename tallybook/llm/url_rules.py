"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefixes, confirmed by full digests.

Each URL becomes the set of expressions a rule could have been written as: every suffix of its host at a
label boundary, times every prefix of its path that is as long as some rule's path. Expressions and rules meet
in an equi-join on the first bytes of their SHA-256; the full digest then confirms the match and the longest
rule decides. Everything is a built-in DataFrame function.

Edge cases: a null URL, or one without `://`, has an empty host and path and fits no rule. A path may be empty
(then only rules with an empty path fit). Repeated rules count once; of rules with the same text and different
verdicts `block` wins. Repeated page rows each get their row. Columns of the page table other than the key and
the URL are not read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.storage import small_side, written

#: Hex digits of the digest used as the join key: 32 bits, as short prefixes of URL blocklists are.
PREFIX_DIGITS = 8
#: A url that is on very many pages is judged in so many parts, so no task has all its pages.
SALTS = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain of it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def match_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Judge every URL by rules of columns (host, path, verdict): the longest fitting rule decides, else `default`.

    Returns key, host, path, rule (its text or null) and verdict, one row per page row.
    """
    listed = (
        rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("rule_verdict"))  # block sorts after allow
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
        .select("prefix", "digest", "rule", "rule_verdict")
    )
    lengths = F.array(*(F.lit(r["n"]) for r in rules.select(F.length("path").alias("n")).distinct().orderBy("n").collect()))  # at most as many as a path can be long
    parts = pages.select(F.col(key), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    fits_none = (F.col("host") == "") & (F.col("path") == "")
    parts = parts.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))  # a url of very many pages is judged once a salt
    judged = parts.where(~fits_none).select("host", "path", "salt").distinct()
    prefixes = F.transform(F.filter(lengths.cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (
        judged.select("host", "path", "salt", F.explode(host_suffixes(F.col("host"))).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "salt", "suffix", F.explode("prefixes").alias("start"))
        .select("host", "path", "salt", F.sha2(F.concat_ws("\n", "suffix", "start"), 256).alias("full"))
        .withColumn("prefix", F.substring("full", 1, PREFIX_DIGITS))
    )
    found = (
        expressions.join(small_side(written(listed)), "prefix")
        .where(F.col("full") == F.col("digest"))
        .groupBy("host", "path", "salt")
        .agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.col("rule"))).alias("hit"))
    )
    columns = [key, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.rule_verdict", F.lit(default)).alias("verdict")]
    empty = parts.where(fits_none).select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return parts.where(~fits_none).join(found, ["host", "path", "salt"], "left").select(*columns).unionAll(empty)
