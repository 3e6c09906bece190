"""Best-fit packing with conflicts: documents into bins of fixed capacity.

Documents are cut into pieces of at most `capacity` bytes. No bin holds two pieces of one source, nor two of one
duplicate cluster. Within a block of rows the pieces, largest first, go to the tightest bin that takes them: bins
are kept in order of their residual capacity, each with a bitmap of the sources and one of the clusters it
holds, and the successor search from the piece's size on goes on until it meets a bin whose bitmaps leave the
piece's bits clear. If there is none, a bin is opened.

Rows are dealt to blocks by a hash of their id, length, source and cluster, so a hot source, cluster or id is spread
like any other; of a row repeated as a whole the copies are counted and dealt one after the other. The number of blocks is
chosen from the row count, for BLOCK_ROWS rows each on average, and bins do not span blocks. Against packing
everything at once this costs at most the open bins of each block.

Edge cases: null and empty texts are pieces of length 0 and take a place like any other; null sources are one
source; nulls and blanks share no cluster. Repeated rows (the same id twice) are packed each. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block on average; a task packs one block at a time.
BLOCK_ROWS = 2_000
#: Bins looked at in one step of the successor search.
STRIDE = 256


class Bins:
    """Open bins in order of residual capacity, with source and cluster bitmaps."""

    def __init__(self, capacity: int, clusters: int):
        self.capacity, self.count, self.opened = capacity, 0, 0
        self.residual, self.number = np.zeros(STRIDE, np.int64), np.zeros(STRIDE, np.int64)
        self.words = 1 + clusters // 64
        self.sources: dict[int, np.ndarray] = {}
        self.bits: dict[int, np.ndarray] = {}

    def _bitmap(self, kind: dict[int, np.ndarray], word: int) -> np.ndarray:
        """Bits 64 * word ... of every bin, by the bin's number."""
        if word not in kind or len(kind[word]) <= self.opened:
            held = kind.get(word, np.zeros(0, np.uint64))
            kind[word] = np.concatenate([held, np.zeros(max(STRIDE, self.opened + 1 - len(held), len(held)), np.uint64)])
        return kind[word]

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) for a piece; cluster -1 conflicts with nothing."""
        of_source, source_bit = self._bitmap(self.sources, source // 64), np.uint64(1 << source % 64)
        of_cluster = self._bitmap(self.bits, cluster // 64) if cluster >= 0 else None
        cluster_bit = np.uint64(1 << cluster % 64) if cluster >= 0 else None
        at, found = int(np.searchsorted(self.residual[: self.count], length)), None
        while at < self.count:
            candidates = self.number[at : min(at + STRIDE, self.count)]
            clear = (of_source[candidates] & source_bit) == 0
            if of_cluster is not None:
                clear &= (of_cluster[candidates] & cluster_bit) == 0
            first = int(clear.argmax())
            if clear[first]:
                found = at + first
                break
            at += STRIDE
        if found is None:
            number, residual = self.opened, self.capacity
            self.opened += 1
        else:
            number, residual = int(self.number[found]), int(self.residual[found])
            self.residual[found : self.count - 1] = self.residual[found + 1 : self.count]
            self.number[found : self.count - 1] = self.number[found + 1 : self.count]
            self.count -= 1
        left = residual - length
        if self.count == len(self.residual):
            self.residual, self.number = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.residual, self.number))
        spot = int(np.searchsorted(self.residual[: self.count], left))
        self.residual[spot + 1 : self.count + 1] = self.residual[spot : self.count].copy()
        self.number[spot + 1 : self.count + 1] = self.number[spot : self.count].copy()
        self.residual[spot], self.number[spot] = left, number
        self.count += 1
        self._bitmap(self.sources, source // 64)[number] |= source_bit
        if cluster >= 0:
            self._bitmap(self.bits, cluster // 64)[number] |= cluster_bit
        return number, self.capacity - residual


def pack_block(block: pd.DataFrame, capacity: int) -> Iterator[tuple]:
    """(row, piece, start, length, bin, offset) for every piece of a block of rows (length, source, cluster)."""
    sources = pd.factorize(block["source"].fillna("\0"))[0]
    codes, names = pd.factorize(block["cluster"])
    lengths = block["length"].to_numpy()
    pieces = [(min(capacity, n - start), row, start) for row, n in enumerate(lengths) for start in range(0, max(n, 1), capacity)]
    several = np.bincount(codes[codes >= 0], minlength=max(1, len(names))) > 1
    dense = np.cumsum(several) - 1  # only clusters with company here, or in several pieces, need a bit
    long = lengths > capacity
    bins = Bins(capacity, int(several.sum()))
    order = sorted(range(len(pieces)), key=lambda k: (-pieces[k][0], pieces[k][1], pieces[k][2]))
    for k in order:
        length, row, start = pieces[k]
        cluster = int(dense[codes[row]]) if codes[row] >= 0 and several[codes[row]] else -1
        number, offset = bins.place(int(length), int(sources[row]), cluster)
        yield row, start // capacity if long[row] else 0, start, int(length), number, offset


def pack(rows: DataFrame, capacity: int, blocks: int) -> DataFrame:
    """Pack rows (doc_id, length, source, cluster): doc_id, piece, start, length, source, bin, offset. `bin` is `block/number`."""

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["length", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        out = pd.DataFrame(pack_block(block, capacity), columns=["row", "piece", "start", "length", "number", "offset"])
        taken = block.iloc[out["row"]].reset_index(drop=True)
        return pd.DataFrame({"doc_id": taken["doc_id"], "piece": out["piece"], "start": out["start"], "length": out["length"], "source": taken["source"], "bin": f"{key[0]}/" + out["number"].astype(str), "offset": out["offset"]})

    schema = "doc_id bigint, piece int, start bigint, length bigint, source string, bin string, offset bigint"
    whole = ("doc_id", "length", "source", "cluster")
    copies = rows.groupBy(*whole).agg(F.count("*").alias("n")).select(*whole, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("copy"))
    dealt = copies.select(*whole, F.pmod(F.pmod(F.xxhash64(*whole), F.lit(blocks)) + F.col("copy"), F.lit(blocks)).cast("int").alias("block"))
    return dealt.groupBy("block").applyInPandas(run, schema)


def cluster_key(text: Column) -> Column:
    """Digest of the text in lower case (of all alphabets) with white space evened out; null for blank texts."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(plain != "", F.md5(plain))


def pack_documents(docs: DataFrame, capacity: int, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Pack whole documents by their UTF-8 bytes; duplicate clusters are texts equal but for case and white space."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("length"), F.col(source).alias("source"), cluster_key(F.col(text)).alias("cluster"))
    return pack(rows, capacity, max(1, docs.count() // BLOCK_ROWS))
