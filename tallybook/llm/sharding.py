"""Sharding: best-fit-decreasing packing of indivisible groups into fixed-capacity shards.

Groups of equal texts are packed whole, largest first, each into the shard with the tightest remaining capacity
that still takes it, found in a balanced tree of remaining capacities. The packing itself sees a bounded summary
only: groups of at least 1/UNITS of all bytes are listed one by one (so at most UNITS of them), smaller ones are
summed up in classes of nearly equal size (eight to an octave), cut by a hash of the group into `parts`. Equal
items (placed by the mean size of their class, which is within a twelfth of each item's) go to a shard in runs, so the plan is a list of rank ranges for each class; Spark ranks the groups within
the classes and joins the ranges. A group larger than a whole shard cannot be placed by any packing; it is split
into as few near-equal pieces as shards can take (where only the number of shards is given, a group may exceed
an even share by a quarter before that).

Edge cases: null texts form a group of their own and empty texts another; repeated rows are rows of one group.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.balanced_tree import BalancedTree
from tallybook.llm.storage import written

#: Groups of at least total / UNITS bytes are placed one by one.
UNITS = 24_000
#: With a given number of shards, a group stays whole up to so many even shares.
WHOLE = 1.25
#: Size classes to an octave for the smaller groups.
STEPS = 8
#: Each shard is numbered in so many runs of rows at least, each by one task.
NUMBERING_RUNS = 64


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def group_key(text: Column) -> Column:
    """SHA-256 of the text; nulls have a key of their own."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"null"))


def best_fit_decreasing(units: Iterable[tuple], capacity: float, shards: int | None = None) -> Iterator[tuple]:
    """Ranges (unit, shard, first, last) for units (unit, size, count), each a number of equal items.

    Items go, largest first, to the tightest shard they fit in. With `shards` given, all are open from the start
    and what fits nowhere goes to the emptiest; otherwise a new shard is opened.
    """
    tree = BalancedTree([(capacity, s) for s in range(shards or 0)])
    opened = shards or 0
    for unit, size, count in sorted(units, key=lambda u: (-u[1], u[0])):
        first = 0
        while first < count:
            spot = tree.successor((size, -1))
            if spot is None and not shards:
                spot, opened = (capacity, opened), opened + 1
                tree.insert(spot)
            spot = spot or tree.largest()
            room, shard = spot
            taken = min(count - first, max(1, math.floor(room / size)))
            tree.remove(spot)
            tree.insert((room - taken * size, shard))
            yield unit, shard, first, first + taken
            first += taken


def shards_of_groups(groups: DataFrame, shards: int | None = None, capacity: int | None = None) -> tuple[DataFrame, DataFrame]:
    """key -> array of shards (one, but for groups larger than a shard) for written groups (key, bytes): at most UNITS large ones, and the others.

    Either the number of shards is given (capacity: an even share) or their capacity (as few shards as the packing needs).
    """
    spark = groups.sparkSession
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    room = capacity or max(1, math.ceil(total / shards))
    least = max(1, math.ceil(total / UNITS))
    parts = min(1024, max(16, count // 200_000))
    big = groups.where(F.col("bytes") >= least).withColumn("pieces", F.ceil(F.col("bytes") / (room if capacity else room * WHOLE)).cast("int"))
    small = groups.where(F.col("bytes") < least).select(
        "key", "bytes", F.floor(F.log2("bytes") * STEPS).cast("int").alias("size_class"), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")
    )
    # At most UNITS rows and a few hundred classes times `parts`: a bounded summary.
    units = [(("big", bytes(r["key"])), r["bytes"] / r["pieces"], r["pieces"]) for r in big.collect()]
    summed = small.groupBy("size_class", "part").agg(F.count("*").alias("n"), F.avg("bytes").alias("mean")).collect()
    units += [(("small", r["size_class"], r["part"]), r["mean"], r["n"]) for r in summed]
    if not capacity:  # what is larger than an even share takes a shard of its own; the others share the rest evenly
        over = [size for _, size, count in units for _ in range(count) if size > room]
        room = (total - sum(over)) / max(1, shards - len(over)) if over else room
    plan = list(best_fit_decreasing(units, room, shards))
    whole: dict[bytes, list[int]] = {}
    for unit, shard, first, last in plan:
        if unit[0] == "big":
            whole.setdefault(unit[1], []).extend([shard] * (last - first))
    placed = spark.createDataFrame([(k, v) for k, v in whole.items()], "key binary, shards array<int>")
    ranges = spark.createDataFrame([(u[1], u[2], shard, a, b) for u, shard, a, b in plan if u[0] == "small"], "size_class int, part int, shard int, first long, last long")
    ranked = small.withColumn("rank", F.row_number().over(Window.partitionBy("size_class", "part").orderBy("key")) - 1)
    runs = (
        ranked.join(F.broadcast(ranges), ["size_class", "part"])  # as bounded as the summary
        .where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
        .select("key", F.array("shard").alias("shards"))
    )
    return placed, runs


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Add `slot`, gapless from 0 in every `shard`: counts of hashed runs give each run's offset, tasks number the runs."""
    cut = rows.withColumn("run", F.pmod(F.xxhash64(order), F.lit(NUMBERING_RUNS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("shard", "run").agg(F.count("*").alias("n")).select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "run").orderBy(order))
    return cut.withColumn("within", within).join(offsets, ["shard", "run"]).withColumn("slot", (F.col("offset") + F.col("within") - 1).cast("bigint")).drop("run", "within", "offset")


def shard_documents(docs: DataFrame, shards: int | None = None, capacity: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every document in its group's shard."""
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), text_bytes(F.col(text)).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), group_key(F.col(text)).alias("key")))
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    large, small = shards_of_groups(groups, shards, capacity)
    large = F.broadcast(large)  # at most UNITS rows; so rows of a hot text stay where they are
    placed = rows.join(large, "key").unionByName(rows.join(large, "key", "left_anti").join(small, "key"))
    piece = F.pmod(F.xxhash64("doc_id"), F.size("shards")).cast("int")
    sharded = written(placed.select("doc_id", "size", "text_crc32", F.get("shards", piece).alias("shard")))
    return numbered(sharded, "doc_id")
