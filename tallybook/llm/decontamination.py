"""Benchmark decontamination: test items found inside documents by size-partitioned MinHash containment.

An item of q distinct word shingles is contained in a document when at least need = ceil(t * q) of them occur there.
Items are partitioned by size (SIZE_LIMITS). Each partition has a sketch length s of its own: an item is represented
by its s smallest shingle hashes under one random permutation (its bottom-s MinHash values), s being the largest
q - need + 1 of the partition's sizes. By the pigeonhole principle a document that contains the item has one of
them, whatever its own length, so recall is 1. A document is sketched for the partitions within its reach alone (one of n
shingles can't hold the least overlap asked for in a partition of larger items): of its hashes only those are looked up whose
value is no higher than the highest that a sketch of these partitions has, which is a third to a half of them. Candidates (text, item)
that met one MinHash value are verified by exact counts of distinct shingles. All of it is built-in DataFrame functions.

Banded MinHash over whole documents is not used: for an item of 30 shingles inside a document of 20,000 the
Jaccard similarity is about 0.0012, so 256 permutations would miss three of four such items.

Edge cases: null and blank texts have no shingles and match nothing; a text of fewer than five words is one
shingle. Rows of one id with different texts are judged each by itself; equal rows give one pair. Equal items of
different ids are all reported. An empty side gives an empty result. Other columns of the tables are not read, so
clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.native_shingles import shingle_hashes, words
from tallybook.llm.storage import small_side, written

#: Upper limits of the size partitions, in shingles; the last one is open.
SIZE_LIMITS = (8, 16, 32, 64, 128, 256)

PERMUTATION_SEED = 20011


def item_shingles(items: DataFrame, item_id: str, text: str, width: int, threshold: float) -> DataFrame:
    """item, q, need, h: one row per distinct shingle of an item."""
    sets = items.select(F.col(item_id).alias("item"), F.array_distinct(shingle_hashes(words(F.col(text)), width)).alias("hs"))
    q = F.size("hs")
    return sets.select("item", q.alias("q"), least_overlap(q, threshold).alias("need"), F.explode("hs").alias("h")).distinct()


def least_overlap(q: Column, threshold: float) -> Column:
    """The shingles a document has to share with an item of q."""
    return F.ceil(F.lit(threshold) * q - F.lit(1e-9)).cast("int")


def permuted(h: Column) -> Column:
    """The value of a hash under the permutation."""
    return F.xxhash64(h, F.lit(PERMUTATION_SEED))


def partition_of(q: Column) -> Column:
    """The size partition, from 0 for the smallest items."""
    return sum((F.when(q > limit, 1).otherwise(0) for limit in SIZE_LIMITS), F.lit(0))


def signatures(shingles: DataFrame, threshold: float) -> DataFrame:
    """part, item, need, value, h: the bottom-s MinHash values of the items, and the hashes that have them."""
    part = partition_of(F.col("q"))
    lengths = F.element_at(F.create_map(*(F.lit(x) for k, limit in enumerate(SIZE_LIMITS) for x in (k, limit))), part)
    # Of the last partition, which has no upper limit, every item has the length of its own size.
    size = F.coalesce(lengths, F.col("q"))
    ranked = (
        shingles.groupBy("item", "q", "need")
        .agg(F.sort_array(F.collect_list(F.struct(permuted(F.col("h")).alias("value"), "h"))).alias("byvalue"))
        .select("item", "need", part.alias("part"), F.explode(F.slice("byvalue", F.lit(1), size - least_overlap(size, threshold) + 1)).alias("low"))
    )
    return ranked.select("part", "item", "need", "low.value", "low.h")


def reach(n: Column, threshold: float) -> Column:
    """The last partition whose smallest items a document of n shingles is large enough for."""
    return sum((F.when(n >= least_overlap(F.lit(limit + 1), threshold), 1).otherwise(0) for limit in SIZE_LIMITS), F.lit(0))


def probes(texts: DataFrame, low: DataFrame, threshold: float, width: int) -> DataFrame:
    """doc, of_text, n, reached, h: the hashes that a document of texts (doc, of_text, body) looks up among the items' sketches."""
    highest = dict(low.groupBy("part").agg(F.max("value")).collect())  # a row for each partition
    reachable = [max((v for p, v in highest.items() if p <= r), default=None) for r in range(len(SIZE_LIMITS) + 1)]
    top = F.get(F.array(*(F.lit(v).cast("bigint") for v in reachable)), F.col("reached"))
    hashed = texts.select("doc", "of_text", shingle_hashes(words(F.col("body")), width).alias("hs"))
    sized = hashed.select("doc", "of_text", F.size("hs").alias("n"), reach(F.size("hs"), threshold).alias("reached"), "hs")
    return sized.select("doc", "of_text", "n", "reached", F.explode(F.filter("hs", lambda h: permuted(h) <= top)).alias("h"))


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """Pairs (doc_id, item_id, shared, item_size) where the document holds at least `threshold` of the item's shingles."""
    shingles = written(item_shingles(items, item_id, text, width, threshold))
    low = written(signatures(shingles, threshold))
    texts = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("of_text"), F.col(text).alias("body"))
    met = probes(texts, low, threshold, width).join(small_side(low.drop("value")), "h").where((F.col("part") <= F.col("reached")) & (F.col("n") >= F.col("need")))
    candidates = written(met.select("doc", "of_text", "item").distinct())
    ids = candidates.select("doc", "of_text").distinct()
    held = (
        texts.join(small_side(written(ids)), ["doc", "of_text"], "left_semi")
        .select("doc", "of_text", F.explode(F.array_distinct(shingle_hashes(words(F.col("body")), width))).alias("h"))
    )
    counted = held.join(candidates.join(shingles, "item"), ["doc", "of_text", "h"]).groupBy("doc", "of_text", "item", "q", "need").agg(F.countDistinct("h").alias("shared"))
    return (
        counted.where(F.col("shared") >= F.col("need"))
        .groupBy("doc", "item", "q").agg(F.max("shared").alias("shared"))
        .select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "shared", F.col("q").cast("bigint").alias("item_size"))
    )
