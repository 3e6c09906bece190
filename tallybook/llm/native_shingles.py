"""Word shingles as built-in column expressions, for operators that run without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, cut at ASCII white space; an empty array for null or blank texts."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(word_array: Column, width: int = 5) -> Column:
    """64-bit hashes of every run of `width` words, in text order; of the whole sequence if it is shorter."""

    def runs(ws: Column) -> Column:
        last = F.greatest(F.size(ws) - (width - 1), F.lit(1))
        hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(ws, i, width)))
        return F.when(F.size(ws) > 0, hashes).otherwise(F.array().cast("array<bigint>"))

    # The words are bound to a lambda's variable: named in place, they would be cut anew for every shingle.
    return F.get(F.transform(F.array(word_array), runs), F.lit(0))
