"""Near-duplicates by n-gram Jaccard similarity: prefix filters under several global orders, then exact sets.

Two documents link when 100 * |A & B| >= THRESHOLD * |A | B| for their sets of five-word shingles. Of two such sets
the prefixes of n - ceil(0.8 n) + l first shingles under some global order share at least l shingles, under every
order there is. Candidates come from the first order (rare shingles first, by a table of counts), where the places of
a shared shingle bound what two sets can share. They are intersected with the candidates of ORDERS further random
orders: the prefixes of a pair must meet under each of them before any set is moved. A map of BITMAP_LONGS * 64 bits
of each set, whose differing bits bound the sets' difference from below, goes before that.

Only components are asked for, so the pairs of a group of copies are never listed:
1. equal sets are one node from the start (grouped by a 128-bit fingerprint; a task sends equal sets once, as far as
   it remembers them);
2. in every bucket of a prefix shingle, neighbours by set size are tested, and every member against the bucket's
   leader (see `leader_pairs`), in large buckets neighbours in PERMUTATIONS random orders too, and links are joined
   to components;
3. in buckets that still hold several components, pairs between different components are tested, apart from those
   tested before. This step makes the result exact: any link between two components would be in it. A set that has
   more shingles outside such buckets before its first ones inside than linked sets may differ in has no link left to
   find, and a posting that stands too late in the order for every size in its bucket can't be the first shared one: both are
   dropped before buckets are joined (see `open_postings`).
Hot buckets are cut into salted chains whose heads form a chain of their own.

Edge cases: null and blank texts have empty sets and link with nothing; fewer than five words are one shingle of
the whole sequence; repeated rows fall into one class. Key and text are the only columns read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.batches import small_batches
from tallybook.llm.components import components
from tallybook.llm.shingles import mix, shingle_sets
from tallybook.llm.storage import small_side, written

THRESHOLD = 80
#: Random orders besides the first, whose prefix filters are intersected.
ORDERS = 2
PERMUTATIONS = 8
#: Counters of the table that orders shingles by frequency; a fixed size, sent in BLOCKS blocks.
COUNTERS, BLOCKS = 1 << 22, 256
BITMAP_LONGS = 8
#: Classes of shingles by count that lie around the mean of the counters, each a quarter of the counters' spread.
LINEAR = 64
#: Rounds of joining links to components before the last step; too few only leave it more to test.
LABEL_ROUNDS = 3
#: Buckets of more postings are also chained in random orders.
LARGE = 64
#: Fingerprints a task remembers having sent; an equal set met later is sent again and linked like any other.
REMEMBERED = 50_000
#: Postings of one shingle expected in one chain; hotter buckets are salted.
CHAIN = 1 << 14
_SHIFT = np.uint64(64 - 22)


def _fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    return int(mix(hashes, 2).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(hashes, 3)).view(np.int64)) if len(hashes) else 0


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP_LONGS * 64, np.uint8)
    bits[hashes & np.uint64(BITMAP_LONGS * 64 - 1)] = 1
    return np.packbits(bits).view(np.int64)


def prefix_length(n: int, shared: int = 1) -> int:
    """So long are the prefixes of two linked sets that they share so many shingles."""
    return n - -(-THRESHOLD * n // 100) + shared


def required(n: int) -> int:
    """Shared prefix shingles asked of a set of size n, one in forty; of a pair, what the smaller set asks."""
    return 1 + n // 40


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.uint32)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
    names = ["doc_id", "n", "f1", "f2", "bits", "block", "counts"]
    for batch in batches:
        ids, n, f1, f2, maps = batch.column(0), [], [], [], []
        for hashes in shingle_sets(batch.column(1)):
            np.add.at(counts, hashes >> _SHIFT, 1)
            a, b = _fingerprint(hashes)
            n.append(len(hashes))
            f1.append(a)
            f2.append(b)
            maps.append(_bitmap(hashes))
        flat = pa.array(np.concatenate(maps) if maps else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BITMAP_LONGS), flat)
        nothing = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists, *nothing], names=names)
    blocks = np.minimum(counts, 65535).astype(np.uint16).reshape(BLOCKS, -1)
    packed = [zlib.compress(b.tobytes(), 1) for b in blocks]
    yield pa.RecordBatch.from_arrays([*(pa.nulls(BLOCKS, k) for k in kinds[:5]), pa.array(range(BLOCKS), pa.int32()), pa.array(packed, pa.binary())], names=names)


def described(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A written table of documents (doc_id, n, f1, f2, bits) and, in rows of their own, the tasks' shingle counts."""
    return written(small_batches(docs.select(doc_id, text)).mapInArrow(_described, "doc_id bigint, n bigint, f1 bigint, f2 bigint, bits array<bigint>, block int, counts binary"))


def _spread(mean: float) -> float:
    """How much a counter of single shingles strays from the mean."""
    return max(1.0, mean**0.5)


def count_class(counts: np.ndarray, mean: float) -> np.ndarray:
    """Quarters of the spread up to LINEAR classes, half octaves above: a shingle's class in the first global order."""
    spread = _spread(mean)
    fine = np.clip(np.floor((counts - mean) / spread * 4) + LINEAR // 2, 0, LINEAR)
    return np.where(fine < LINEAR, fine, np.clip(LINEAR + np.floor(2 * np.log2(np.maximum(counts, 1) / (mean + LINEAR / 8 * spread))), LINEAR, 120)).astype(np.uint8)


def class_count(mean: float) -> np.ndarray:
    """The largest count of each class."""
    classes, spread = np.arange(121), _spread(mean)
    return np.where(classes < LINEAR, mean + (classes + 1 - LINEAR // 2) * spread / 4, (mean + LINEAR / 8 * spread) * 2 ** ((classes + 1 - LINEAR) / 2))


def frequency_classes(table: DataFrame) -> tuple[np.ndarray, float]:
    """The class of each counter, COUNTERS bytes, and the mean count."""
    total = table.where("block IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mean = total / COUNTERS

    def classify(block: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(COUNTERS // BLOCKS)
        for packed in block["counts"]:
            counts += np.frombuffer(zlib.decompress(packed), np.uint16)
        return pd.DataFrame({"block": block["block"].iloc[:1], "classes": [count_class(counts, mean).tobytes()]})

    blocks = table.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInPandas(classify, "block int, classes binary")
    found = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.uint8)
    for row in blocks.collect():  # BLOCKS rows, COUNTERS bytes
        found[row["block"]] = np.frombuffer(row["classes"], np.uint8)
    return found.ravel(), mean


def postings(docs: DataFrame, doc_id: str, text: str, classes: np.ndarray, mean: float) -> DataFrame:
    """token, cell, doc, at: the prefix of every different set under the first order; a task sends equal sets once.

    cell: of how many salted chains a hot token has (upper half), which one it is (lower); at: the set's size and the place in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    salts_of = np.maximum(1, (class_count(mean) - mean) / CHAIN).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sent = shared.value, set()
        for batch in batches:
            tokens, owners, sizes, places = [], [], [], []
            for doc, hashes in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1))):
                n = len(hashes)
                if not n or (mark := _fingerprint(hashes)) in sent:
                    continue
                if len(sent) < REMEMBERED:
                    sent.add(mark)
                p = min(n, prefix_length(n, required(n)))
                keys = held[hashes >> _SHIFT].astype(np.uint64) << np.uint64(56) | hashes & np.uint64((1 << 56) - 1)
                tokens.append(np.sort(np.partition(keys, p - 1)[:p]))
                places.append(np.arange(p, dtype=np.int32))
                owners.append(np.full(p, doc))
                sizes.append(np.full(p, n))
            if tokens:
                token, owner = np.concatenate(tokens), np.concatenate(owners)
                salts = salts_of[(token >> np.uint64(56)).astype(np.int64)]
                salt = (mix(owner.astype(np.uint64)) % salts.astype(np.uint64)).astype(np.int32)
                columns = [token.view(np.int64), salts << 32 | salt, owner, np.concatenate(sizes).astype(np.int64) << 32 | np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["token", "cell", "doc", "at"])

    return small_batches(docs.select(doc_id, text)).mapInArrow(run, "token bigint, cell bigint, doc bigint, at bigint")


def _compatible(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= THRESHOLD * F.greatest(n, m)


def _required(n: Column, m: Column) -> Column:
    return (F.least(n, m) / 40).cast("int") + 1


def _overlap(n: Column, m: Column) -> Column:
    """The least number of shingles that linked sets of sizes n and m share."""
    return F.floor((THRESHOLD * (n + m) + 99 + THRESHOLD) / (100 + THRESHOLD)).cast("int")


def _early(n: Column, pos: Column, m: Column, place: Column) -> Column:
    """Whether a shared shingle can be among the first that two linked sets share, by its places in the order.

    Linked sets of sizes n and m share o shingles at least, so the first l of them stand at n - o + l - 1 or before.
    """
    slack = _required(n, m) - 1 - _overlap(n, m)
    return _compatible(n, m) & (pos <= n + slack) & (place <= m + slack)


def _pairs(rows: DataFrame, left: str, right: str) -> DataFrame:
    return rows.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where("a <> b")


def size_chains(rows: DataFrame) -> DataFrame:
    """Postings of shared tokens, each with its predecessor by set size in its (salted) bucket."""
    upper, lower = (lambda c: F.shiftright(c, 32).cast("int")), (lambda c: c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))  # the rows move before they are unpacked
    rows = rows.repartition("token", "cell").select("token", "cell", upper(F.col("cell")).alias("salts"), "doc", upper(F.col("at")).alias("n"), lower(F.col("at")).alias("pos"))
    w = Window.partitionBy("token", "cell").orderBy("n", "doc")
    chained = rows.withColumns({"before": F.lag("doc").over(w), "before_n": F.lag("n").over(w), "before_pos": F.lag("pos").over(w), "after": F.lead("doc").over(w)})
    return chained.where("before IS NOT NULL OR after IS NOT NULL OR salts > 1").drop("after", "cell")


def chain_pairs(chained: DataFrame) -> DataFrame:
    """Neighbours by size that are so in at least half as many buckets as linked sets have to share."""
    near = chained.where(F.col("before").isNotNull() & _early(F.col("n"), F.col("pos"), F.col("before_n"), F.col("before_pos")))
    counted = near.withColumn("asked", _required(F.col("n"), F.col("before_n"))).groupBy("doc", "before").agg(F.count("*").alias("met"), F.max("asked").alias("asked"))
    heads = chained.where("salts > 1 AND before IS NULL").withColumn("other", F.lag("doc").over(Window.partitionBy("token").orderBy("n", "doc")))
    return _pairs(counted.where("2 * met >= asked"), "doc", "before").unionAll(_pairs(heads.where("other IS NOT NULL"), "doc", "other"))


def leader_pairs(live: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's leader, the document with the largest share of its prefix in shared buckets.

    Copies that differ from their original in different places may link with it alone; it has no shingles of its own.
    """
    share = live.groupBy("doc").agg((F.count("*") / F.first("n")).alias("share"))
    owned = live.join(share, "doc")
    leaders = owned.groupBy("token").agg(F.max_by(F.struct("doc", "n", "pos"), F.struct("share", -F.col("doc"))).alias("leader"), F.count("*").alias("held"))
    led = live.join(leaders.where("held > 2").select("token", F.col("leader.doc").alias("other"), F.col("leader.n").alias("other_n"), F.col("leader.pos").alias("other_pos")), "token")
    near = led.where((F.col("doc") != F.col("other")) & _early(F.col("n"), F.col("pos"), F.col("other_n"), F.col("other_pos"))).withColumn("asked", _required(F.col("n"), F.col("other_n")))
    counted = near.groupBy("doc", "other").agg(F.count("*").alias("met"), F.max("asked").alias("asked"))
    return _pairs(counted.where("2 * met >= asked"), "doc", "other")


def shuffled_pairs(live: DataFrame) -> DataFrame:
    """Neighbours in one of PERMUTATIONS random orders of each large bucket."""
    large = live.groupBy("token").agg(F.count("*").alias("held")).where(F.col("held") > LARGE)
    order, salt = F.xxhash64("doc", F.pmod("token", F.lit(PERMUTATIONS))), F.pmod(F.xxhash64("doc"), F.ceil(F.col("held") / CHAIN))
    w = Window.partitionBy("token", salt).orderBy(order, "doc")
    neighbours = live.join(large, "token").withColumns({"other": F.lag("doc").over(w), "other_n": F.lag("n").over(w), "other_pos": F.lag("pos").over(w)})
    return _pairs(neighbours.where(F.col("other").isNotNull() & _early(F.col("n"), F.col("pos"), F.col("other_n"), F.col("other_pos"))), "doc", "other")


def _linked(left: np.ndarray, right: np.ndarray) -> bool:
    both = np.concatenate([left, right])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= THRESHOLD * (len(both) - shared)


def further_prefix(hashes: np.ndarray, order: int) -> np.ndarray:
    """The prefix of a set under one of the further orders, as short hashes; two that are equal by chance only let a pair through."""
    p = prefix_length(len(hashes))
    return (np.partition(mix(hashes, 11 + order), p - 1)[:p] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [h for h in shingle_sets(batch.column(1))]
        columns = [pa.array([further_prefix(h, k) if len(h) else None for h in sets], pa.list_(pa.int32())) for k in range(ORDERS)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc", *(f"order_{k}" for k in range(ORDERS))])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, left, right = batch.columns
        keep = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(left, right)]
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = pa.array([h.tobytes() for h in shingle_sets(batch.column(1))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), packed], names=["doc", "hashes"])


def links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Those of the candidate pairs (a, b) that link, written."""
    maps = nodes.select(F.col("doc_id").alias("doc"), F.col("n").alias("size"), "bits")
    one, two = (maps.select(F.col("doc").alias(k), F.col("size").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    differing = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("n_a") + F.col("n_b")
    mapped = pairs.join(one, "a").join(two, "b").where(_compatible(F.col("n_a"), F.col("n_b")))
    mapped = written(mapped.where((100 + THRESHOLD) * differing <= (100 - THRESHOLD) * total).select("a", "b"))
    kinds = ", ".join(f"order_{k} array<int>" for k in range(ORDERS))
    met = _of_ends(mapped, small_batches(_texts_of(mapped, docs, doc_id, text)).mapInArrow(_prefixes, f"doc bigint, {kinds}"))
    for k in range(ORDERS):
        met = met.where(F.arrays_overlap(f"order_{k}_a", f"order_{k}_b"))
    survivors = written(met.select("a", "b"))
    ready = _of_ends(survivors, small_batches(_texts_of(survivors, docs, doc_id, text)).mapInArrow(_sets, "doc bigint, hashes binary"))
    return written(ready.select("a", "b", "hashes_a", "hashes_b").mapInArrow(_verified, "a bigint, b bigint"))


def _texts_of(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Key and text of the documents that are in a pair."""
    ids = written(pairs.select("a").unionAll(pairs.select("b")).distinct().withColumnRenamed("a", doc_id))
    return docs.select(doc_id, text).join(small_side(ids), doc_id, "left_semi")


def _of_ends(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs with the rows (doc, ...) of both of their documents, columns marked _a and _b."""
    for end in "ab":
        pairs = pairs.join(rows.select(*(F.col(c).alias(end if c == "doc" else f"{c}_{end}") for c in rows.columns)), end)
    return pairs


def _mixed(rows: DataFrame) -> DataFrame:
    """Postings of buckets that hold several components, with the smallest set size there."""
    held = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least_n"))
    return rows.join(held.where("low <> high").select("token", "least_n"), "token")


def open_postings(live: DataFrame, found: DataFrame) -> DataFrame:
    """Postings that may still be the first shingle shared by two sets of different components, with the component of each."""
    mixed = written(_mixed(live.join(found, live["doc"] == found["node"], "left").select("token", "doc", "n", "pos", F.coalesce("root", "doc").alias("label"))))
    n, eighty = F.col("n"), F.floor((THRESHOLD * F.col("n") + 99) / 100).cast("int")
    # Linked sets share `first` shingles in both prefixes at least; the one of that rank among the postings left tells
    # how many shingles stand before it that no set of another component shares.
    first = _required(eighty, eighty)
    own = mixed.groupBy("doc", "n").agg(F.sort_array(F.collect_list("pos")).alias("places")).select("doc", (F.get("places", first - 1) - first + 1).alias("own"))
    room = n - _overlap(n, F.greatest("least_n", eighty))
    held = mixed.join(own, "doc").where((F.col("pos") <= room) & (F.col("own") <= room)).drop("least_n")
    return written(_mixed(held).drop("least_n"))


def crossing_pairs(rows: DataFrame) -> DataFrame:
    """Pairs between different components of a bucket that may link: those outside its largest component against everything."""
    sizes = rows.groupBy("token", "label").agg(F.count("*").alias("held"))
    main = sizes.groupBy("token").agg(F.max_by("label", F.struct("held", "label")).alias("main"))
    told = rows.join(main, "token")
    small = told.where("label <> main").select("token", *(F.col(c).alias(f"{c}_s") for c in ("doc", "n", "pos", "own", "label")))
    apart = (F.col("label") != F.col("label_s")) & ((F.col("label") == F.col("main")) | (F.col("doc_s") < F.col("doc")))
    asked = _overlap(F.col("n"), F.col("n_s"))
    can = (F.greatest("pos", "own") <= F.col("n") - asked) & (F.greatest("pos_s", "own_s") <= F.col("n_s") - asked)
    return _pairs(small.join(told, "token").where(apart & _compatible(F.col("n"), F.col("n_s")) & can), "doc_s", "doc").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every document."""
    table = described(docs, doc_id, text)
    nodes = table.where("block IS NULL").select("doc_id", "n", "f1", "f2", "bits")
    classes, mean = frequency_classes(table)
    chained = written(size_chains(postings(docs, doc_id, text, classes, mean)))
    live = chained.select("token", "doc", "n", "pos")

    tested = written(chain_pairs(chained).unionAll(leader_pairs(live)).unionAll(shuffled_pairs(live)).distinct())
    first = links(tested, docs, nodes, doc_id, text)
    crossing = written(crossing_pairs(open_postings(live, components(first, rounds=LABEL_ROUNDS))).join(tested, ["a", "b"], "left_anti"))
    edges = first.unionAll(links(crossing, docs, nodes, doc_id, text))

    sets = nodes.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    sets = written(sets)
    of_doc = nodes.select("doc_id", "f1", "f2")
    ends = written(edges.select("a").unionAll(edges.select("b")).distinct().withColumnRenamed("a", "doc_id").join(of_doc, "doc_id").join(sets, ["f1", "f2"]).select("doc_id", "first"))
    between = edges.join(ends.select(F.col("doc_id").alias("a"), F.col("first").alias("first_a")), "a").join(ends.select(F.col("doc_id").alias("b"), F.col("first").alias("first_b")), "b")
    found = components(between, "first_a", "first_b")
    classes_of = written(sets.join(found, sets["first"] == found["node"], "left").where("copies > 1 OR root IS NOT NULL").select("f1", "f2", F.coalesce("root", "first").alias("root")))
    full = nodes.where("n > 0").select("doc_id", "n", "f1", "f2").join(classes_of, ["f1", "f2"], "left").select("doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
    empty = nodes.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("root"))
    return full.unionAll(empty).select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))
