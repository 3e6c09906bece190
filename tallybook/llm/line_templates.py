"""Line dedup with a log-template tree.

Lines are parsed to a fixed depth: by their token count, then by their first LEADING tokens, where a token with a
digit counts as a variable. Below that, each leaf tells constant fields from variable ones: a token is constant at
its position if it stands there in MIN_TEXTS lines of the leaf. A line's template is its leaf with its constant
tokens; it holds only if at least CONSTANT of the tokens without digits are constant, otherwise (and in leaves of
fewer lines) a line is a template of its own.

A template recurs if it is found in MIN_DOCUMENTS independent documents, long ones (LONG_WORDS words) in LONG_DOCUMENTS.
Lines of recurring templates are dropped, in every document. How often a line stands in one document doesn't matter.

Independence: copied and edited documents share their lines without these being boilerplate. So adjoining lines that
other texts have too (blank lines between them skipped) form a run, and what a text has outside the run is sketched
by the least hash of WIDTH-word shingles in each of SKETCH classes. Texts that agree in two adjoining classes are taken
for copies of each other, joined over ROUNDS rounds, and count as one document. A text with less than OWN of its words outside a run
tells nothing about the run: it would be a near-duplicate (four fifths of the words of both) of any other such text. A large group of copies can neither make its lines recur nor outvote other documents.

Lines that can't be of a template of several lines are left out early: leaves and long lines are counted by their
hashes, and the tasks get filters of the frequent ones (BITS_EACH bits for each, so filters follow what recurs, not the
number of lines); what a filter lets through by chance meets the exact counts. Sketches are taken of texts alone that have
a line of a template found in enough texts. All counts are grouped sums with partial aggregation, so
a hot line costs a few rows per task. Texts aren't shuffled: the recurring lines are sent to the documents if they are
counted to be few (`BROADCAST_ROWS`), else positions are joined to the documents by the hash of their text.

Edge cases: null texts stay null; empty and blank lines have no tokens and always stay, so does everything in an
empty table. Repeated rows and documents with equal texts are one text. Rows are told apart by their text, not by a
key, so rows of one id with different texts each keep their own lines. Columns of the input that have the name of an
added column are replaced by it; the names are parameters. Others are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallybook.llm.batches import map_rows, small_batches
from tallybook.llm.shingles import NO_HASH, shingle_minima
from tallybook.llm.storage import BROADCAST_ROWS, small_side, unused, written

LEADING = 3
MIN_TEXTS = 5
CONSTANT = 0.7
MIN_DOCUMENTS = 5
LONG_WORDS, LONG_DOCUMENTS = 50, 2
#: Two texts of which all but a ninth is the same have a Jaccard similarity of 0.8.
OWN = 1 / 9
SKETCH, WIDTH = 16, 3
ROUNDS = 2
#: Bits of a filter for each hash in it, and the most it has in all.
BITS_EACH, FILTER_BITS = 256, 1 << 27
#: Lines whose fields a task remembers having sent; others are sent again, and once is enough.
REMEMBERED = 100_000

_DIGIT = re.compile(r"\d")
_PARTS = [f"s{k}" for k in range(SKETCH)]


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def leaf_of(tokens: list[str]) -> int:
    """Hash of the token count and the leading tokens, variables masked."""
    return _hash("\x00".join((str(len(tokens)), *("<*>" if _DIGIT.search(t) else t for t in tokens[:LEADING]))))


def field_keys(leaf: int, tokens: list[str]) -> list[int]:
    """A hash for every (leaf, position, token); a token with a digit is variable and has 0."""
    return [0 if _DIGIT.search(t) else _signed(_hash(f"{k}\x00{t}", leaf & 0xFFFFFFFFFFFF)) for k, t in enumerate(tokens)]


def _counted(text: str | None) -> Iterator[tuple]:
    for line in (text or "").split("\n"):
        if tokens := line.split():
            yield 0, _signed(leaf_of(tokens))
            if len(tokens) >= LONG_WORDS:
                yield 1, _signed(_hash(line))


def frequent(docs: DataFrame, text: str) -> DataFrame:
    """A written table (kind, hash) of the leaves of MIN_TEXTS lines (kind 0) and of the long lines that stand twice (1)."""
    counted = map_rows(docs.select(text), _counted, "kind int, hash bigint").groupBy("kind", "hash").count()
    return written(counted.where((F.col("count") >= MIN_TEXTS) | (F.col("kind") == 1) & (F.col("count") > 1)).select("kind", "hash"))


def hash_filter(hashes: DataFrame, column: str) -> bytes:
    """A bit for every hash of a written table; the driver gets 64 of them in a row, and a row at most for each hash."""
    size = min(FILTER_BITS, 1 << max(6, (BITS_EACH * hashes.count()).bit_length()))
    word = F.shiftright(F.col(column).bitwiseAND(F.lit(size - 1)), 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(column).bitwiseAND(F.lit(63)).cast("int"))
    found = hashes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(size >> 6, "<i8")
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits.tobytes()


def passes(held: bytes, value: int) -> bool:
    """Whether a filter lets a hash through: all that are in it, and few others."""
    return bool(held[(value >> 3) & (len(held) - 1)] >> (value & 7) & 1)


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """One row for every line of a text that may be of a template of several lines.

    whole: hash of the text; line: the line's; words: how many; keys: fields, the first time a task meets a line of a
    frequent leaf.
    """
    found = frequent(docs, text)
    leaves, long_lines = (docs.sparkSession.sparkContext.broadcast(hash_filter(found.where(F.col("kind") == k), "hash")) for k in (0, 1))
    names, kinds = ["whole", "line", "words", "keys"], [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_leaves, repeated, sent = leaves.value, long_lines.value, set()
        for batch in batches:
            rows = []
            for of_text, whole in zip(*(c.to_pylist() for c in batch.columns)):
                for line in dict.fromkeys((whole or "").split("\n")):
                    if not (tokens := line.split()):
                        continue
                    leaf, own, keys = leaf_of(tokens), None, None
                    if passes(frequent_leaves, leaf):
                        own = _signed(_hash(line))
                        if own not in sent:
                            if len(sent) < REMEMBERED:
                                sent.add(own)
                            keys = field_keys(leaf, tokens)
                    elif len(tokens) >= LONG_WORDS and passes(repeated, value := _hash(line)):
                        own = _signed(value)
                    if own is not None:
                        rows.append((of_text, own, len(tokens), keys))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)

    return small_batches(docs.select(F.xxhash64(text).alias("whole"), text)).mapInArrow(run, "whole bigint, line bigint, words int, keys array<bigint>")


def templates_of(seen: DataFrame) -> DataFrame:
    """line, template, asked: the template of every line, and in how many documents it has to be found."""
    lines = seen.groupBy("line", "whole").agg(F.first("words").alias("words")).groupBy("line").agg(F.count("*").alias("texts"), F.first("words").alias("words"))
    fields = seen.where("keys IS NOT NULL").groupBy("line").agg(F.first("keys").alias("keys"))
    lines = written(lines.join(fields, "line", "left"))
    keys = lines.select("line", "texts", F.explode("keys").alias("key")).where("key <> 0")
    constant = keys.groupBy("key").agg(F.sum("texts").alias("held")).where(F.col("held") >= MIN_TEXTS).select("key")
    parsed = keys.join(constant, "key").groupBy("line").agg(F.count("*").alias("constants"), F.bit_xor(F.xxhash64("key")).alias("fields"))
    plain = F.size(F.filter("keys", lambda key: key != 0))
    holds = F.col("constants") >= F.greatest(plain * CONSTANT, F.lit(1))
    asked = F.when(F.col("words") >= LONG_WORDS, LONG_DOCUMENTS).otherwise(MIN_DOCUMENTS)
    return lines.join(parsed, "line", "left").select("line", F.when(holds, F.xxhash64("words", "fields")).otherwise(F.col("line")).alias("template"), asked.alias("asked"))


def common_templates(seen: DataFrame, templates: DataFrame) -> DataFrame:
    """template, least: the templates found in as many texts as documents are asked for."""
    held = seen.groupBy("line", "whole").agg(F.lit(1).alias("one")).join(templates, "line")
    return (
        held.groupBy("template", "whole").agg(F.min("asked").alias("asked"))
        .groupBy("template").agg(F.count("*").alias("texts"), F.min("asked").alias("least"))
        .where("texts >= least").select("template", "least")
    )


def occurrences(docs: DataFrame, text: str, lines: DataFrame) -> DataFrame:
    """One row for every line that is in a written table of lines, and one (line null) for all other lines of its text.

    whole: hash of the text; place: the line's number without blank ones (-1 for the others); line_no: with them;
    line: its hash; words, total: of the line, of the text; s0...: the sketch. A few other lines have rows of their own too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hash_filter(lines, "line"))
    names = ["whole", "place", "line_no", "line", "words", "total", *_PARTS]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            rows, lines = [], []
            for of_text, whole in zip(*(c.to_pylist() for c in batch.columns)):
                cut = [(k, line) for k, line in enumerate((whole or "").split("\n")) if line.strip()]
                hashes = [_hash(line) for _, line in cut]
                passed = [place for place, value in enumerate(hashes) if passes(held, value)]
                if not passed:
                    continue
                words = [len(line.split()) for _, line in cut]
                total, apart = sum(words), set(passed)
                for place in passed:
                    rows.append((of_text, place, cut[place][0], _signed(hashes[place]), words[place], total, 1))
                    lines.append(cut[place][1])
                rest = [line for place, (_, line) in enumerate(cut) if place not in apart]
                rows.append((of_text, -1, None, None, 0, total, len(rest)))
                lines.extend(rest)
            if not rows:
                continue
            made, sketches, k = shingle_minima(pa.array(lines, pa.large_string()), SKETCH, WIDTH), [], 0
            for row in rows:
                sketches.append(made[k : k + row[6]].min(axis=0, initial=NO_HASH))
                k += row[6]
            columns = [*list(zip(*rows))[:6], *np.array(sketches).T]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    schema = f"whole bigint, place int, line_no int, line bigint, words int, total int, {', '.join(f'{s} bigint' for s in _PARTS)}"
    return small_batches(docs.select(F.xxhash64(text).alias("whole"), text)).mapInArrow(run, schema)


def run_labels(shared: DataFrame) -> DataFrame:
    """template, label for the runs of shared lines in texts that tell of them; copies have one label.

    `shared` has the texts' rows, once for each text, with the template where a line is shared and null elsewhere.
    """
    by_place = Window.partitionBy("whole").orderBy("place")
    before, after = by_place.rowsBetween(Window.unboundedPreceding, -1), by_place.rowsBetween(1, Window.unboundedFollowing)
    around = {f"{s}_{side}": F.min(s).over(w) for s in _PARTS for side, w in (("before", before), ("after", after))}
    run = F.col("place") - F.row_number().over(Window.partitionBy("whole", F.col("template").isNull()).orderBy("place"))
    ends = [F.least(F.min_by(f"{s}_before", "place"), F.max_by(f"{s}_after", "place")).alias(s) for s in _PARTS]
    runs = (
        shared.withColumn("_any", F.count("template").over(Window.partitionBy("whole"))).where("_any > 0").drop("_any").withColumns(around).withColumn("run", run).where("template IS NOT NULL")
        .groupBy("whole", "run", "total").agg(*ends, F.sum("words").alias("inside"), F.collect_set("template").alias("templates"))
        .where((F.col("total") - F.col("inside")) >= F.greatest(F.col("total") * OWN, F.lit(1)))
    )
    runs = written(runs.select(F.xxhash64("whole", "run").alias("item"), "templates", F.array(*_PARTS).alias("sketch")))
    pairs = [F.when((F.get("sketch", F.lit(k)) < NO_HASH) & (F.get("sketch", F.lit((k + 1) % SKETCH)) < NO_HASH), F.xxhash64(F.lit(k), F.get("sketch", F.lit(k)), F.get("sketch", F.lit((k + 1) % SKETCH)))) for k in range(SKETCH)]
    values = written(runs.select("item", F.explode(F.array_compact(F.array(*pairs))).alias("value")))
    labels = values.select("item", F.col("item").alias("label")).distinct()
    for _ in range(ROUNDS):
        least = values.join(labels, "item").groupBy("value").agg(F.min("label").alias("label"))
        labels = written(values.join(least, "value").groupBy("item").agg(F.min("label").alias("label")))
    return runs.join(labels, "item", "left").select(F.explode("templates").alias("template"), F.coalesce("label", "item").alias("label"))


def recurring_lines(held: DataFrame, of_lines: DataFrame, common: DataFrame) -> DataFrame:
    """The line hashes whose template recurs across documents, from written tables of occurrences, of the lines of common templates and of these."""
    texts = held.groupBy("whole", "place").agg(*(F.first(c).alias(c) for c in ("line", "words", "total", *_PARTS)))
    shared = texts.join(small_side(of_lines), "line", "left")
    told = run_labels(shared).groupBy("template", "label").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("documents"))
    recurring = told.join(common, "template").where("documents >= least").select("template")
    return of_lines.join(recurring, "template").select("line")


def drop_recurring_lines(docs: DataFrame, text: str = "text", lines: str = "lines", dropped: str = "dropped") -> DataFrame:
    """The documents with all lines of recurring templates taken out of their text.

    Added columns: `lines` (how many there were) and `dropped` (positions from 0 of those taken out).
    """
    seen = written(candidates(docs, text))
    templates = written(templates_of(seen))
    common = written(common_templates(seen, templates))
    of_lines = written(templates.join(common, "template").select("line", "template"))
    held = written(occurrences(docs, text, of_lines))
    recurring = written(recurring_lines(held, of_lines, common))
    plain = docs.drop(lines, dropped)
    if recurring.count() <= BROADCAST_ROWS:
        return _cut_by_lines(plain, text, lines, dropped, recurring)
    of_text = F.xxhash64(text)
    found = held.join(recurring, "line").groupBy("whole").agg(F.sort_array(F.collect_set("line_no")).alias(dropped))
    own = unused("whole", plain.columns)
    joined = plain.join(found.withColumnRenamed("whole", own), of_text == F.col(own), "left").drop(own)
    cut = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(cut, lambda line, k: ~F.array_contains(dropped, k)), "\n")
    shorter = F.when(F.col(dropped).isNull(), F.col(text)).otherwise(kept)
    return joined.withColumns({lines: F.coalesce(F.size(cut), F.lit(0)), text: shorter, dropped: F.coalesce(dropped, F.array().cast("array<int>"))})


def _cut_by_lines(docs: DataFrame, text: str, lines: str, dropped: str, recurring: DataFrame) -> DataFrame:
    """Documents without the lines of a list of hashes whose length is checked, in one pass."""
    gone = docs.sparkSession.sparkContext.broadcast(np.sort(recurring.toArrow()["line"].to_numpy()))
    schema = docs.withColumns({lines: F.lit(0), dropped: F.array().cast("array<int>")}).schema
    arrow, at = to_arrow_schema(schema), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [None if t is None else t.split("\n") for t in batch.column(at).to_pylist()]
            hashes = np.array([_signed(_hash(line)) for t in cut if t for line in t], np.int64)
            places = np.searchsorted(gone.value, hashes)
            hit = (gone.value[np.minimum(places, len(gone.value) - 1)] == hashes) if len(gone.value) else np.zeros(len(hashes), bool)
            texts, positions, counts, k = [], [], [], 0
            for t in cut:
                flags = hit[k : k + len(t or ())]
                k += len(flags)
                positions.append([n for n, (f, line) in enumerate(zip(flags, t or ())) if f and line.strip()])
                of_line = set(positions[-1])
                texts.append(None if t is None else "\n".join(line for n, line in enumerate(t) if n not in of_line))
                counts.append(len(t or ()))
            columns = [pa.array(texts, arrow.field(c).type) if c == at else batch.column(c) for c in range(batch.num_columns)]
            columns += [pa.array(counts, pa.int32()), pa.array(positions, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return small_batches(docs).mapInArrow(run, schema)
