"""Substring dedup by seed and extend: passages of `length` words or more that an earlier document has too.

A window is `length` consecutive words. Its seed is the k-gram of words with the least hash in it (the winnowed
anchor; the leftmost of equal ones), so equal windows have the same seed at the same place, and a text has about one
seed for every twenty words. Consecutive windows with one seed are a stretch: the seed extended to both sides as far
as windows that contain it reach.

1. Documents are joined on seeds: stretches whose seed stands in one document only are dropped.
2. Stretches equal word for word (by a 128-bit digest) are matched whole: all but the smallest doc_id's are repeats.
   The smallest document's stretch stands for the others.
3. Where a seed has several such stretches left, their extensions end somewhere around it: their windows are compared
   one by one, again by digests and a grouped minimum. Each window is in one stretch, so nothing is compared twice.

What is covered is joined to maximal repeats and cut out. Groups, however large, only take grouped minima and joins on
narrow rows, never pairs; texts move once at most for each of two joins, not at all while the lists they meet are small.

Edge cases: null and blank texts have no words, keep an empty text and repeat nothing. A null doc_id is neither smaller
nor larger than another: such rows keep all their words and take none from others. Rows of one doc_id don't
shorten each other, whether their texts are equal or not, and repeats within one document stay. Equal passages of
many documents stay in the smallest doc_id alone, in all its rows. An empty table gives an empty one; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.batches import map_rows, small_batches
from tallybook.llm.shingles import _power_tables, mix
from tallybook.llm.storage import written

LENGTH = 50
#: Words of a seed; every window of 50 words has 41 to choose from.
SEED = 10
#: Lists of spans are broadcast while they have so many entries together, else the join shuffles.
BROADCAST_ENTRIES = 2_000_000

_VALUES = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Low bits of a sliding minimum hold the place: a text has fewer than 2**31 bytes, so fewer than 2**30 words.
_PLACE = np.uint64((1 << 30) - 1)

STRETCHES = "doc_id bigint, of_text bigint, seed bigint, digest_a bigint, digest_b bigint, start int, stop int"
WINDOWS = "doc_id bigint, of_text bigint, digest_a bigint, digest_b bigint, start int"


def word_bounds(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each begins and ends."""
    words = text.split()  # ASCII white space
    plain = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 0x20)
    return plain, np.concatenate([[0], gaps + 1]) if words else gaps, np.append(gaps, len(plain)) if words else gaps


def seed_hashes(plain: bytes, begins: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` words."""
    data = np.frombuffer(plain, np.uint8)
    up, down = _power_tables(_BASE, len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=running[1:])
    first = begins[: len(begins) - width + 1]
    return mix((running[ends[width - 1 :]] - running[first]) * down[first])


def winnowed(seeds: np.ndarray, choice: int) -> np.ndarray:
    """The place of the least seed (the leftmost) in every run of `choice` seeds."""
    least = (seeds & ~_PLACE) | np.arange(len(seeds), dtype=np.uint64)
    span = 1
    while 2 * span <= choice:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < choice:
        least = np.minimum(least[: span - choice], least[choice - span :])
    return (least & _PLACE).astype(np.int64)


def digests(plain: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of each slice, as two integers."""
    view = memoryview(plain)
    joined = b"".join(blake2b(view[a:b], digest_size=16).digest() for a, b in zip(begins.tolist(), ends.tolist()))
    return np.frombuffer(joined, "<i8").reshape(-1, 2)


def stretches(text: bytes, length: int, width: int) -> tuple[np.ndarray, ...] | None:
    """seed, digest_a, digest_b, start, stop of a text's stretches; none if it has no window."""
    plain, begins, ends = word_bounds(text)
    if len(begins) < length:
        return None
    seeds = seed_hashes(plain, begins, ends, width)
    places = winnowed(seeds, length - width + 1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(places)) + 1])
    stop = np.append(first[1:], len(places)) + length - 1
    digest = digests(plain, begins[first], ends[stop - 1])
    return seeds[places[first]].view(np.int64), digest[:, 0], digest[:, 1], first.astype(np.int32), stop.astype(np.int32)


def windows(text: bytes, spans: list[dict], length: int) -> tuple[np.ndarray, ...]:
    """digest_a, digest_b, start of the windows inside the spans."""
    plain, begins, ends = word_bounds(text)
    start = np.concatenate([np.arange(s["start"], s["stop"] - length + 1) for s in spans])
    digest = digests(plain, begins[start], ends[start + length - 1])
    return digest[:, 0], digest[:, 1], start.astype(np.int32)


def _per_text(df: DataFrame, function, schema: str) -> DataFrame:
    """Rows (doc_id, of_text, *columns) for the columns that `function(*others)` makes of a row (doc_id, of_text, *others)."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64() if c.endswith("bigint") else pa.int32() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list[np.ndarray]] = [[] for _ in names]
            held = 0
            for doc_id, of_text, *others in zip(*(c.to_pylist() for c in batch.columns)):
                if (columns := function(*others)) is None:
                    continue
                n = len(columns[0])
                for out, values in zip(made, (np.full(n, doc_id), np.full(n, of_text), *columns)):
                    out.append(values)
                held += n
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(made, kinds)], names)
                    made, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(made, kinds)], names)
        pa.default_memory_pool().release_unused()

    return small_batches(df).mapInArrow(run, schema)


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted spans joined where they touch or overlap, as maximal ones."""
    out: list[list[int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["stop"])
        else:
            out.append([s["start"], s["stop"]])
    return [tuple(s) for s in out]


def _listed(rows: DataFrame) -> DataFrame:
    """doc_id, of_text, spans: a text's spans (no more than it has words), sorted."""
    return rows.distinct().groupBy("doc_id", "of_text").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def _few(lists: DataFrame) -> DataFrame:
    rows, entries = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    return lists.hint("broadcast") if rows + entries <= BROADCAST_ENTRIES else lists


def _several(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that stand in more than one document, with the smallest doc_id. Written, so that a join with it can split the rows of a hot key."""
    return written(rows.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, of_text (the text's xxhash64), spans: the maximal runs of words covered by windows of a smaller doc_id."""
    width = seed or max(1, min(SEED, length // 5))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("of_text"), F.col(text).cast("binary").alias("body")).where("doc_id IS NOT NULL AND body IS NOT NULL")
    cut = written(_per_text(texts, lambda body: stretches(body, length, width), STRETCHES))
    shared = written(cut.join(_several(cut, ["seed"]).select("seed"), "seed"))
    smallest = written(shared.groupBy("digest_a", "digest_b").agg(F.min("doc_id").alias("least")))
    judged = written(shared.join(smallest, ["digest_a", "digest_b"]))
    standing = judged.where("doc_id = least").drop("least")
    open_ends = standing.join(_several(standing, ["seed"]).select("seed"), "seed")
    asked = written(_listed(open_ends.select("doc_id", "of_text", "start", "stop")))
    met = texts.join(_few(asked), ["doc_id", "of_text"]).select("doc_id", "of_text", "body", "spans")
    compared = written(_per_text(met, lambda body, spans: windows(body, spans, length), WINDOWS))
    covered = compared.join(_several(compared, ["digest_a", "digest_b"]), ["digest_a", "digest_b"]).where("doc_id > least")
    found = judged.where("doc_id > least").select("doc_id", "of_text", "start", "stop").unionAll(covered.select("doc_id", "of_text", "start", F.col("start") + length))

    def maximal(doc_id: int, of_text: int, spans: list[dict]) -> Iterator[tuple]:
        yield doc_id, of_text, merged(spans)

    return map_rows(_listed(found), maximal, "doc_id bigint, of_text bigint, spans array<struct<start:int,stop:int>>")


def without_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed, in words), kept (the other words joined by one space) of every row."""
    spans = written(repeated_spans(docs, length, doc_id=doc_id, text=text))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("of_text"), F.col(text).cast("binary").alias("body"))
    met = texts.join(_few(spans), ["doc_id", "of_text"], "left").select("doc_id", "body", "spans")

    def cut(doc_id: int | None, body: bytes | None, spans: list[dict] | None) -> Iterator[tuple]:
        words, removed = (body or b"").split(), spans or []
        ends = [0, *(s["stop"] for s in removed)]
        kept = [w for a, b in zip(ends, [*(s["start"] for s in removed), len(words)]) for w in words[a:b]]
        yield doc_id, len(words), len(words) - len(kept), [(s["start"], s["stop"]) for s in removed], b" ".join(kept)

    out = map_rows(met, cut, "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,stop:int>>, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))
