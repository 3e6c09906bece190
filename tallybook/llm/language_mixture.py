"""Language identification: each document as a mixture of languages, fitted by expectation-maximisation.

Training counts byte trigrams of every labelled training row, per language, hashed into BUCKETS counters; Spark
sums them, so the model covers all rows. It has MODEL counters at most: with more languages than these allow for
(64), the counters of neighbouring buckets are joined, so a label column full of noise makes it coarser, not larger. A document's words are its units:
a word's likelihood under a language is the product of its trigrams' probabilities. Expectation-maximisation
finds the proportions of the languages; the language set is the one with the highest likelihood less PENALTY
times half the logarithm of the number of words per language in it. The prediction is the largest proportion; its score
is the mean probability of that language over the words, each judged by itself with all languages alike beforehand.

Edge cases: null texts and texts without a letter are `und` with score 0; so is everything when no labelled row
could be learned from. Ties go to the first language in sorted order. Rows are judged one by one, whole texts,
so repeated rows get equal answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.batches import map_rows, small_batches

BUCKETS = 1 << 16
SMOOTHING = 0.5
ITERATIONS = 12
#: Times half the logarithm of the number of words, for each language in the set; guards against chance words.
PENALTY = 8.0
#: Counters of the model.
MODEL = BUCKETS * 64
UNDETERMINED = "und"

_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def trigram_buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams centred on each byte of each word, and where each word's begin."""
    joined = b" ".join((b"", *text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split(), b""))
    data = np.frombuffer(joined, np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761) >> np.uint32(16)
    inside = data[1:-1] != 0x20
    first = inside & (data[:-2] == 0x20)
    return codes[inside].astype(np.int64), np.flatnonzero(first[inside])


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _joined(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets of trigrams in a model of fewer than BUCKETS."""
    return ids >> (BUCKETS // buckets).bit_length() - 1


#: Trigrams looked up in the model at once.
AT_ONCE = 1 << 15


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            held = counts.setdefault(lang, np.zeros(buckets, np.int64))
            ids = _joined(trigram_buckets(text)[0], buckets)
            if len(ids) < buckets // 4:
                np.add.at(held, ids, 1)
            else:
                held += np.bincount(ids, minlength=buckets)
    for lang, held in counts.items():
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(held[used], pa.int64())], ["lang", "bucket", "n"])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Sorted languages and their log probabilities (buckets x languages) from all rows that aren't held out."""
    rows = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    languages = sorted(r[0] for r in rows.select(lang).distinct().collect())
    buckets = BUCKETS
    while buckets > 1 and buckets * len(languages) > MODEL:
        buckets //= 2
    counted = small_batches(rows).mapInArrow(lambda batches: _count(batches, buckets), "lang string, bucket bigint, n bigint")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most MODEL rows
    counts = np.full((buckets, len(languages)), SMOOTHING)
    place = {x: k for k, x in enumerate(languages)}
    counts[table["bucket"].to_numpy(), [place[x] for x in table["lang"].to_pylist()]] += table["n"].to_numpy()
    return languages, (np.log(counts) - np.log(counts.sum(axis=0))).astype(np.float32)


def mixture(loglik: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the member languages and the log likelihood, by expectation-maximisation over words."""
    part = loglik[:, members]
    top = part.max(axis=1, keepdims=True)
    likelihood = np.exp(part - top)
    share = np.full(len(members), 1.0 / len(members))
    if len(members) > 1:
        for _ in range(ITERATIONS):
            weighted = likelihood * share
            fresh = (weighted / weighted.sum(axis=1, keepdims=True)).mean(axis=0)
            done = np.abs(fresh - share).max() < 1e-4
            share = fresh
            if done:
                break
    return share, float(np.log(likelihood @ share).sum() + top.sum())


def language_set(loglik: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The languages with the best penalised likelihood, and their proportions."""
    order = np.argsort(-mixture(loglik, np.arange(loglik.shape[1]))[0], kind="stable")
    cost, best = PENALTY * 0.5 * np.log(len(loglik) + 1), None
    for size in range(1, len(order) + 1):
        share, value = mixture(loglik, order[:size])
        if best is not None and value - cost * size <= best[0]:
            break
        best = (value - cost * size, order[:size], share)
    return best[1], best[2]


def word_likelihoods(table: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log likelihood of each word under each language; AT_ONCE trigrams at a time, so memory follows the words, not the bytes."""
    ids, ends = _joined(ids, len(table)), np.append(starts[1:], len(ids))
    out, at = np.zeros((len(starts), table.shape[1])), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + AT_ONCE)) - 1)
        begin, end = int(starts[at]), int(ends[to - 1])
        if to == at + 1:
            for k in range(begin, end, AT_ONCE):  # a word of any length
                out[at] += np.add.reduceat(table[ids[k : min(end, k + AT_ONCE)]], [0], axis=0)[0]
        else:
            out[at:to] = np.add.reduceat(table[ids[begin:end]], starts[at:to] - begin, axis=0)
        at = to
    return out


def certainty(loglik: np.ndarray, language: int) -> float:
    """The mean over words of a language's probability, all languages being as likely beforehand."""
    likelihood = np.exp(loglik - loglik.max(axis=1, keepdims=True))
    return float((likelihood[:, language] / likelihood.sum(axis=1)).mean())


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and shares (language -> proportion) of every row."""
    languages, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def judge(key: int, words: str | None) -> Iterator[tuple]:
        ids, starts = trigram_buckets(words or "")
        if not len(starts) or not languages or not any(c.isalpha() for c in words):
            yield key, UNDETERMINED, 0.0, []
            return
        loglik = word_likelihoods(shared.value, ids, starts)
        members, share = language_set(loglik)
        top = max(range(len(members)), key=lambda k: (share[k], -members[k]))
        yield key, languages[members[top]], min(1.0, certainty(loglik, members[top])), [(languages[m], float(s)) for m, s in zip(members, share)]

    return map_rows(docs.select(doc_id, text), judge, "doc_id bigint, lang_pred string, score double, shares map<string,double>")


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language that holds at least the share `least` of it."""
    languages, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)
    column = docs.columns.index(text)

    def accepted(words: str | None) -> bool:
        ids, starts = trigram_buckets(words or "")
        if not len(starts) or not languages or not any(c.isalpha() for c in words):
            return False
        return bool(language_set(word_likelihoods(shared.value, ids, starts))[1].max() >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([accepted(t) for t in batch.column(column).to_pylist()], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
