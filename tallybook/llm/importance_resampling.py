"""Target-distribution importance resampling: documents drawn by how much their hashed n-grams look like a target's.

Features are words and pairs of words, hashed into `buckets`. One pass counts the buckets of the corpus, each task into an
array of its own; the logarithmic ratio of target to corpus frequency of every bucket is an array of gains (`buckets` integers,
the only thing sent to the driver and back). A second pass looks a document's features up in that array: its weight is their
mean. Gumbel noise from a digest of the doc_id makes the top scores a draw without replacement; the k-th score is found
by quickselect, and only the winners are sorted.

Edge cases: null and blank texts have no features, a weight of 0 and are not drawn; documents of fewer than
`least_words` words aren't drawn either. A null doc_id has no noise: its score is null and it is neither counted nor drawn.
Rows of one doc_id are judged each; of rows equal in score, doc_id and number of features as many are drawn as there is room
for. An empty corpus gives an empty table, an empty target or one without words leaves the smoothed ratios. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.batches import small_batches
from tallybook.llm.quickselect import first_in_order
from tallybook.llm.storage import written

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7

#: Bytes: A-Z lower-cased, all other ASCII but letters and digits to a space; what is beyond ASCII belongs to words.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """ASCII letters and digits and all beyond ASCII in runs, lower-cased."""
    return (text or b"").translate(_PLAIN).split()


def feature_hashes(words: list[bytes]) -> np.ndarray:
    """CRC-32 of every word, then of every two consecutive words joined by one space."""
    alone = [crc32(w) for w in words]
    spaced = [crc32(b" ", c) for c in alone[:-1]]
    return np.array(alone + [crc32(w, c) for w, c in zip(words[1:], spaced)], np.int64)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """bucket, n: the features of all texts, counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                if words := words_of(body):
                    counts += np.bincount(feature_hashes(words) % buckets, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], ["bucket", "n"])

    counted = small_batches(docs.select(F.col(text).cast("binary"))).mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) of every bucket, add-one smoothed, from tables of counts."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for array, counts in ((s, corpus), (t, target)):
        for bucket, n in counts.collect():  # at most `buckets` rows
            array[bucket] = n
    above, under = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * above / ((float(a) + 1) * under))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column(1).to_pylist():
                words = words_of(body)
                found = feature_hashes(words) % buckets
                rows.append((len(words), len(found), int(gain[found].sum()) // len(found) if len(found) else 0))
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_features", "weight"])
        pa.default_memory_pool().release_unused()

    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    return small_batches(texts).mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel_noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) for a u told by a digest of the doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; the drawn ones have a rank."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    score = F.col("weight") + gumbel_noise(F.col("doc_id"), seed)
    scored = written(weighed(docs, gain).withColumn("score", score).withColumn("_least_first", -F.col("score")))
    eligible = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    k = percent * scored.where(eligible).count() // 100
    return first_in_order(scored, ["_least_first", "doc_id", "n_features"], k, eligible).drop("_least_first")
