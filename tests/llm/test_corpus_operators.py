"""Operators that look across documents, against brute force on small fixtures, and the pipeline."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybook.llm import best_fit_packing, components, decontamination, line_templates, near_duplicates, sharding, url_rules
from tallybook.llm.shingles import shingle_sets
from tallybook.llm.storage import stage, written

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", None if k % 9 == 0 else f"s{k % 4}", len(t or ""), "clash") for k, t in enumerate(texts)], SCHEMA)


def word_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(n)] for n in (120, 80, 60, 40, 12, 300)]
    out = [None, "", " \n ", "one two", "One  TWO", "a b c d e"]
    for words in base:
        for edits in (0, 0, 1, 1, 2, 3, 4, 6):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    passage = " ".join(word() for _ in range(30))
    out += [passage + " " + " ".join(word() for _ in range(rng.randint(5, 25))) for _ in range(30)]
    return out + [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(30)]


def brute_components(texts):
    sets, root = [word_shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def test_near_duplicates(spark, texts):
    got = near_duplicates.near_duplicates(docs_of(spark, texts))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(texts)


def edited_group(rng, word, size, copies):
    """Copies of one text with words replaced, inserted and deleted: many pairs just above and below the threshold, of different sizes."""
    base = [word() for _ in range(size)]
    for _ in range(copies):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            at, kind = rng.randrange(len(copy)), rng.random()
            if kind < 0.4:
                copy[at] = word()
            elif kind < 0.7:
                copy.insert(at, word())
            else:
                del copy[at]
        yield " ".join(copy)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_of_edited_groups(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(40)]
    texts = [t for size in (35, 60, 66, 110) for t in edited_group(rng, word, size, 90)]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(4, 14))]) for _ in range(90)]
    texts += ["word " * 300_000, " ".join(word() for _ in range(60_000))]  # longer than a chunk
    got = near_duplicates.near_duplicates(docs_of(spark, texts))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(texts)


def test_near_duplicates_empty(spark):
    assert near_duplicates.near_duplicates(docs_of(spark, ["x"]).where("false")).count() == 0


def test_components(spark):
    rng, edges = random.Random(1), [(k, k + 1) for k in range(100, 180)] + [(5, 5), (7, 9), (9, 7)]
    edges += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    rng.shuffle(edges)
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k != 5}


def test_line_templates(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    own = lambda: " ".join(word() for _ in range(12))
    fixed = "all rights are reserved by the publisher of this page"
    varied = lambda k: f"posted by user{k} on day {k} in the main forum of the city"
    passage = " ".join(word() for _ in range(60))
    texts = [f"{own()}\n{fixed}\n{own()}\n\n{varied(k)}\n{own()}" for k in range(12)] + [f"{own()}\n{passage}\n{own()}" for _ in range(8)]
    whole = "\n".join(own() for _ in range(6))
    texts += [whole] * 20 + [None, "", "\n", own()]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(docs_of(spark, texts)).collect()}
    for k, text in enumerate(texts):
        expected = [] if not 0 <= k < 20 else [1, 4] if k < 12 else [1]
        assert got[k]["dropped"] == expected, k
        assert got[k]["text"] == (text if not expected else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in expected))
    assert got[0]["label"] == "clash"
    assert line_templates.drop_recurring_lines(docs_of(spark, ["x"]).where("false")).count() == 0


def test_line_templates_passages(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    own = lambda: " ".join(word() for _ in range(12))
    notice, passage = own(), [own() for _ in range(5)]
    texts = ["\n\n".join([own(), notice, own(), own()]) for _ in range(12)] + ["\n".join([own(), *passage, own(), own()]) for _ in range(12)]
    copied = [own() for _ in range(12)]
    for k in range(12):  # near copies: nothing of them goes
        texts.append("\n".join([*copied[:k], own(), *copied[k + 1 :]]))
    got = {r["doc_id"]: r["dropped"] for r in line_templates.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert [got[k] for k in range(36)] == [[2]] * 12 + [[1, 2, 3, 4, 5]] * 12 + [[]] * 12


def test_line_templates_copy_group(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    own = lambda: " ".join(word() for _ in range(12))
    notice = own()
    texts = [f"{own()}\n{notice}\n{own()}" for _ in range(10)]
    copied = [own(), own(), own(), notice, *(own() for _ in range(8))]
    for k in range(60):
        at = (0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11)[k % 11]
        texts.append("\n".join([*copied[:at], own(), *copied[at + 1 :]]))
    got = {r["doc_id"]: r["dropped"] for r in line_templates.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert [got[k] for k in range(70)] == [[1]] * 10 + [[3]] * 60


def _own(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    return lambda n=12: " ".join(word() for _ in range(n))


def dropped_of(spark, texts):
    return {r["doc_id"]: r["dropped"] for r in line_templates.drop_recurring_lines(docs_of(spark, texts)).collect()}


def test_line_templates_footer_chorus_and_fields(spark):
    own = _own(16)
    footer = [own(6), own(8), own(5)]
    texts = ["\n".join([own(), own(), *footer]) for _ in range(20)]
    chorus = own()
    texts.append("\n".join(x for _ in range(6) for x in (own(), chorus)))
    texts += [f"{own()}\nPage {k} of 10\n{own()}\nPosted here by {own(1)} on 2024-01-0{k}" for k in range(1, 8)]
    got = dropped_of(spark, texts)
    assert [got[k] for k in range(28)] == [[2, 3, 4]] * 20 + [[]] + [[1, 3]] * 7


@pytest.mark.parametrize("words, gone", [(14, True), (16, True), (4, False)])
def test_line_templates_of_mostly_boilerplate(spark, words, gone):
    """Unrelated documents of five shared lines and few words of their own; below a ninth of its words a text is a near-duplicate."""
    own = _own(40)
    shared = [own(12) for _ in range(5)]
    texts = ["\n".join([own(words), *shared]) for _ in range(40)]
    got = line_templates.drop_recurring_lines(docs_of(spark, texts)).collect()
    assert all(len(r["dropped"]) == (5 if gone else 0) for r in got)


def test_line_templates_copies_of_two_lines(spark):
    """Copies edited in one of two lines keep the other; a long passage of two unrelated documents goes, of two copies it stays."""
    own = _own(17)
    first, second = own(40), own(40)
    texts = []
    for k in range(30):
        words = first.split()
        words[k % 40], words[(k * 7 + 3) % 40] = own(2).split()
        texts.append(" ".join(words) + "\n" + second)
    passage = own(60)
    texts += [f"{own(30)}\n{passage}", f"{passage}\n{own(30)}"]
    other, kept = own(60), own(30).split()
    texts += [f"{' '.join(kept)}\n{other}", f"{' '.join(kept[:-1])} x\n{other}"]
    got = dropped_of(spark, texts)
    assert [got[k] for k in range(34)] == [[]] * 30 + [[1], [0]] + [[], []]


def brute_recurring(texts):
    """Recurring templates by plain Python: dicts, sets and full closure of what copies agree in."""
    texts = sorted({t for t in texts if t})
    cut = {t: [(k, line) for k, line in enumerate(t.split("\n")) if line.split()] for t in texts}
    digit = re.compile(r"\d")
    leaf_lines, holders = defaultdict(int), defaultdict(set)
    leaf = lambda line: (len(line.split()), *("*" if digit.search(x) else x for x in line.split()[:3]))
    for t in texts:
        for _, line in cut[t]:
            leaf_lines[leaf(line)] += 1
            holders[line].add(t)
    field = Counter()
    for line, held in holders.items():
        for at in enumerate(line.split()):
            field[leaf(line), at] += len(held)
    template = {}
    for line in holders:
        plain = [x for x in enumerate(line.split()) if not digit.search(x[1])]
        fixed = [x for x in plain if field[leaf(line), x] >= 5]
        template[line] = (len(line.split()), leaf(line), *fixed) if leaf_lines[leaf(line)] >= 5 and fixed and len(fixed) >= 0.7 * len(plain) else line
    texts_of = defaultdict(set)
    for line, held in holders.items():
        texts_of[template[line]] |= held
    asked = {template[line]: 2 if len(line.split()) >= 50 else 5 for line in holders}
    shared = {t for t, held in texts_of.items() if len(held) >= asked[t]}
    runs = []
    for t in texts:
        marks = [template[line] in shared for _, line in cut[t]]
        for begin in range(len(marks)):
            if marks[begin] and not (begin and marks[begin - 1]):
                end = begin
                while end < len(marks) and marks[end]:
                    end += 1
                outside = [line for k, (_, line) in enumerate(cut[t]) if not begin <= k < end]
                words = sum(len(line.split()) for line in outside)
                if words >= max(1, sum(len(line.split()) for _, line in cut[t]) / 9):
                    hashes = np.unique(np.concatenate(list(shingle_sets(pa.array(outside), 3)))).tolist()
                    least = {k: min(h for h in hashes if h % 16 == k) for k in {h % 16 for h in hashes}}
                    sketch = {(least[k], least[(k + 1) % 16]) for k in least if (k + 1) % 16 in least}
                    runs.append(({template[line] for _, line in cut[t][begin:end]}, sketch))
    root = list(range(len(runs)))
    changed = True
    while changed:
        changed = False
        for a in range(len(runs)):
            for b in range(a):
                if root[a] != root[b] and runs[a][1] & runs[b][1]:
                    root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
                    changed = True
    labels = defaultdict(set)
    for (held, _), r in zip(runs, root):
        for t in held:
            labels[t].add(r)
    return lambda line: bool(line.split()) and template[line] in shared and len(labels[template[line]]) >= asked[template[line]]


def test_line_templates_brute(spark):
    own = _own(18)
    notes = [own(5), own(9), own(55)]
    rng = random.Random(2)
    texts = [None, "", " \n", "one"]
    for k in range(60):
        lines = [own(rng.randint(3, 14)) for _ in range(rng.randint(1, 5))]
        for note in notes:
            if rng.random() < 0.2:
                lines.insert(rng.randint(0, len(lines)), note)
        if rng.random() < 0.3:
            lines.append(f"issue {rng.randint(1, 99)} of the year {rng.randint(1900, 2000)} in print")
        texts.append("\n".join(lines))
        for _ in range(rng.choice((0, 0, 0, 1, 8))):
            at = rng.randrange(len(lines))
            texts.append("\n".join([*lines[:at], lines[at] + " " + own(1), *lines[at + 1 :]]))
    recurs, got = brute_recurring(texts), dropped_of(spark, texts)
    for k, t in enumerate(texts):
        assert got[k] == [n for n, line in enumerate((t or "").split("\n")) if line.strip() and recurs(line)], k
    assert any(got.values())


def test_line_templates_names_and_ids(spark):
    """Columns named like the added ones are replaced, rows of one id with different texts keep their own lines, both ways of cutting agree."""
    own = _own(19)
    footer = own(6)
    rows = [(k // 2, f"{own()}\n{own()}\n{footer}" if k % 2 else f"{footer}\n{own()}", "old", "old", k) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines string, dropped string, whole int")
    got = line_templates.drop_recurring_lines(docs)
    assert {(r["whole"], r["lines"], tuple(r["dropped"])) for r in got.collect()} == {(k, 3, (2,)) if k % 2 else (k, 2, (0,)) for k in range(20)}
    limit = line_templates.BROADCAST_ROWS
    try:
        line_templates.BROADCAST_ROWS = 0
        other = line_templates.drop_recurring_lines(docs)
        assert sorted(map(str, other.select(sorted(other.columns)).collect())) == sorted(map(str, got.select(sorted(got.columns)).collect()))
    finally:
        line_templates.BROADCAST_ROWS = limit


def test_line_templates_tables_follow_what_recurs(spark, monkeypatch):
    """60,000 long lines that stand once leave no row in any table; a filter that lets everything through changes no result."""
    word = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda k: F.translate(F.substring(F.md5(F.concat_ws("-", F.col("line"), k)), 1, 8), "0123456789", "ghijklmnop"))
    lines = spark.range(60_000).select((F.col("id") % 3000).alias("doc_id"), F.col("id").alias("line")).withColumn("text", F.array_join(word, " "))
    docs = lines.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    rows = []

    def counted(df, write=line_templates.written):
        rows.append((table := write(df)).count())
        return table

    monkeypatch.setattr(line_templates, "written", counted)
    got = line_templates.drop_recurring_lines(docs)
    assert len(rows) > 5 and not any(rows)
    assert got.where("lines = 20 AND size(dropped) = 0").count() == 3000

    own = _own(41)
    footer, long_one = own(7), own(55)
    texts = ["\n".join([own(), *[footer] * (k % 2), own(60), *[long_one] * (k % 5 == 0), own()]) for k in range(40)]
    exact = dropped_of(spark, texts)
    monkeypatch.setattr(line_templates, "FILTER_BITS", 64)
    assert dropped_of(spark, texts) == exact == {k: [n for n, here in ((1, k % 2), (2 + k % 2, k % 5 == 0)) if here] for k in range(40)}


def test_packing(spark, texts):
    docs = docs_of(spark, [*texts, "long " * 500, "long " * 500])
    rows = best_fit_packing.pack_documents(docs, 1000).collect()
    lengths = {k: len((t or "").encode()) for k, t in enumerate([*texts, "long " * 500, "long " * 500])}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_bin[r["bin"]].append(r)
    assert set(by_doc) == set(lengths)
    for k, pieces in by_doc.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length <= 1000
            at += length
        assert at == lengths[k]
    cluster = {r["doc_id"]: r["c"] for r in docs.select("doc_id", best_fit_packing.cluster_key(F.col("text")).alias("c")).collect()}
    for held in by_bin.values():
        assert sum(r["length"] for r in held) <= 1000
        assert max(Counter(r["source"] for r in held).values()) == 1
        assert max(Counter(cluster[r["doc_id"]] or r["doc_id"] for r in held).values()) == 1
        assert sorted(r["offset"] for r in held)[0] == 0
    assert best_fit_packing.pack_documents(docs.where("false"), 1000).count() == 0


def test_packing_of_a_repeated_row(spark):
    """A row repeated as a whole is spread over the blocks; op4 packs each of its rows, and no bin holds two pieces of a source."""
    rows = spark.range(6_000).selectExpr("7L AS doc_id", "100L AS length", "'hot' AS source", "'c' AS cluster").unionAll(spark.range(300).selectExpr("id + 10 AS doc_id", "id AS length", "concat('s', id % 50) AS source", "CAST(null AS STRING) AS cluster"))
    packed = best_fit_packing.pack(rows, 1_000, 10).withColumn("block", F.split("bin", "/")[0])
    assert packed.groupBy("doc_id").count().where("doc_id = 7").first()["count"] == 6_000 and packed.count() == 6_300
    assert {r["count"] for r in packed.where("doc_id = 7").groupBy("block").count().collect()} == {600}
    assert packed.groupBy("bin", "source").count().where("count > 1").count() == 0


def test_op4_blocks_against_naive(spark, sf_dir):
    """The registered query: every document once, bins within the capacity, no source or duplicate cluster twice in a bin."""
    from tallybook.llm import op4

    packed = op4.op4_best_fit_packing(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = docs.select("doc_id", best_fit_packing.cluster_key(F.col("text")).alias("cluster"))
    rows = [r.asDict() for r in packed.join(key, "doc_id").collect()]
    length = {r["doc_id"]: len((r["text"] or "").encode()) for r in docs.collect()}
    total, bins = Counter(), defaultdict(list)
    for r in rows:
        total[r["doc_id"]] += r["length"]
        bins[r["bin"]].append(r)
    assert total == Counter(length)
    for held in bins.values():
        held.sort(key=lambda r: (r["offset"], r["length"]))
        assert sum(r["length"] for r in held) <= 16_384 and all(a["offset"] + a["length"] <= b["offset"] for a, b in zip(held, held[1:]))
        sources, clusters = [r["source"] for r in held], [r["cluster"] for r in held if r["cluster"]]
        assert len(set(sources)) == len(sources) and len(set(clusters)) == len(clusters)


def test_best_fit_against_naive():
    import pandas as pd

    rng = random.Random(6)
    block = pd.DataFrame({"length": [rng.randint(0, 900) for _ in range(300)], "source": [f"s{rng.randint(0, 70)}" for _ in range(300)], "cluster": [rng.choice([None, *map(str, range(80))]) for _ in range(300)]})
    block = block.sort_values("length", ascending=False, kind="stable").reset_index(drop=True)
    got = {(r, p): (b, o) for r, p, _, _, b, o in best_fit_packing.pack_block(block, 700)}
    bins, expected = [], {}
    pieces = sorted(((min(700, n - s), r, s) for r, n in enumerate(block["length"]) for s in range(0, max(n, 1), 700)), key=lambda x: (-x[0], x[1], x[2]))
    for length, r, s in pieces:
        source, cluster = block["source"][r], block["cluster"][r]
        fits = [b for b in bins if b["left"] >= length and source not in b["sources"] and (cluster is None or cluster not in b["clusters"])]
        if not fits:
            bins.append({"left": 700, "sources": set(), "clusters": set(), "id": len(bins)})
            fits = [bins[-1]]
        least = min(b["left"] for b in fits)
        place = got[r, s // 700][0]
        chosen = next(b for b in fits if b["id"] == place)
        assert chosen["left"] == least
        chosen["left"] -= length
        chosen["sources"].add(source)
        chosen["clusters"].add(cluster)
        expected[r, s] = place
    assert len(expected) == len(got)


def test_contained_items(spark, texts):
    rng = random.Random(8)
    items = [(k, " ".join(texts[20 + k].split()[: 10 + 3 * k])) for k in range(8)] + [(50, None), (51, ""), (52, "one two"), (53, "one two")]
    long = " ".join("".join(rng.choice("xyz") for _ in range(5)) for _ in range(4000)).split()
    long[2000:2000] = items[5][1].split()
    edited = items[7][1].split()
    edited[3] = "changed"
    docs = [*texts, " ".join(long), " ".join(edited)]
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["item_size"]) for r in decontamination.contained_items(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = {}
    for k, text in enumerate(docs):
        for item, words in items:
            q, shared = word_shingles(words), len(word_shingles(words) & word_shingles(text))
            if q and 10 * shared >= 8 * len(q):
                expected[k, item] = (shared, len(q))
    assert got == expected and (len(docs) - 2, 5) in got
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained_items(docs_of(spark, docs), nothing).count() == 0


def test_contained_items_partitions(spark):
    """Items of every size partition, at the threshold and just below; rows of one id, repeated rows, clashing names, no documents."""
    own, rows, items, expected = _own(21), [], [], set()
    for k, q in enumerate((1, 7, 8, 9, 16, 17, 33, 64, 65, 129, 257, 400)):
        words = own(q + 4).split()
        items.append((k, " ".join(words), "x"))
        most = q - -(-8 * q // 10)  # so many shingles may be missing
        for miss in {0, most, min(q, most + 1)}:
            text = f"{own(40)} {' '.join(words[: len(words) - miss])} {own(40)}"
            rows.append((len(rows), text, "x"))
            if q - miss >= 0.8 * q and q > miss:
                expected.add((len(rows) - 1, k, q - miss))
    rows += [rows[0], (0, own(9), "y"), (0, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string").withColumns({"item": F.lit(1), "h": F.lit(1)})
    got = decontamination.contained_items(docs, spark.createDataFrame(items, "item_id long, text string, q string"))
    assert sorted((r["doc_id"], r["item_id"], r["shared"]) for r in got.collect()) == sorted(expected)
    assert decontamination.contained_items(docs.where("false"), spark.createDataFrame(items, "item_id long, text string, q string")).count() == 0


def test_documents_look_up_what_they_can_hold(spark):
    """Sketches of the partitions within reach cut the looked-up hashes; what the documents hold is found all the same."""
    own = _own(31)
    items = [(k, own(q + 4)) for k, q in enumerate((30, 60, 120, 400))]
    rows = [(k, f"{own(300)} {items[k % 3][1]} {own(300)}") for k in range(30)] + [(100 + k, own(40)) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = decontamination.item_shingles(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 5, 0.8)
    low = decontamination.written(decontamination.signatures(table, 0.8))
    texts = docs.select(F.col("doc_id").alias("doc"), F.lit(0).alias("of_text"), F.col("text").alias("body"))
    looked = decontamination.probes(texts, low, 0.8, 5)
    total = sum(len(word_shingles(t)) for _, t in rows)
    assert 0 < looked.count() < 0.6 * total
    assert not looked.where("n < 25 AND reached > 2").count()  # 24 of 30 shingles are asked of the smallest item there is
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contained_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k % 3) for k in range(30)}


def test_sharding(spark, texts):
    rows = sharding.shard_documents(docs_of(spark, texts * 3).withColumn("doc_id", F.monotonically_increasing_id()), shards=5).collect()
    assert len(rows) == 3 * len(texts)
    for shard in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) < 0.1 * max(loads.values())
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(s) <= 2 for s in by_text.values()) and sum(len(s) == 1 for s in by_text.values()) > 0.9 * len(by_text)
    assert sharding.shard_documents(docs_of(spark, texts).where("false"), shards=5).count() == 0
    hot = sharding.shard_documents(docs_of(spark, ["same text"] * 50 + texts), shards=4).collect()
    assert len({r["shard"] for r in hot if r["text_crc32"] == zlib.crc32(b"same text")}) >= 1 and len(hot) == 50 + len(texts)


def test_op8_brute(spark, sf_dir):
    """The registered query against best-fit-decreasing over a plain list of shards; only groups below 1/UNITS of all bytes are placed by a class mean."""
    from tallybook.llm.op8 import SHARDS, op8_sharding

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = op8_sharding(spark, sf_dir).collect()
    size = {k: len((t or "").encode()) + 8 for k, t in texts.items()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {k: (size[k], zlib.crc32((t or "").encode())) for k, t in texts.items()}
    groups = defaultdict(list)
    for k, t in texts.items():
        groups[t].append(k)
    sizes = sorted((sum(size[k] for k in ks) for ks in groups.values()), reverse=True)
    even = -(-sum(sizes) // SHARDS)
    assert sizes[0] < even
    loads = [0] * SHARDS
    for n in sizes:
        fits = [s for s in range(SHARDS) if loads[s] + n <= sum(sizes) / SHARDS]
        loads[max(fits, key=lambda s: (loads[s], -s)) if fits else min(range(SHARDS), key=lambda s: (loads[s], -s))] += n
    found, shard_of, slots = [0] * SHARDS, {}, defaultdict(list)
    for r in got:
        found[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert shard_of.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
    assert max(abs(a - b) for a, b in zip(sorted(found), sorted(loads))) <= 3 * sum(sizes) // 24_000
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_best_fit_decreasing():
    units = [("a", 7, 3), ("b", 4, 4), ("c", 2, 5), ("d", 1, 3)]
    plan = list(sharding.best_fit_decreasing(units, 10))
    sizes, loads = dict((u, s) for u, s, _ in units), Counter()
    for unit, shard, first, last in plan:
        loads[shard] += sizes[unit] * (last - first)
    assert max(loads.values()) <= 10 and len(loads) == 5  # 50 in bins of 10
    for unit, _, count in units:
        assert sorted(k for u, _, a, b in plan for k in range(a, b) if u == unit) == list(range(count))


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("a.com", "/x", "block"), ("a.com", "/x/y/", "allow"), ("b.net", "", "block"), ("b.net", "", "allow")], "host string, path string, verdict string")
    urls = [None, "", "no scheme", "http://COM/", "http://com", "https://q.A.com/x?z", "https://a.com/xyz#f", "https://a.com/x/y/z", "http://ba.com/x", "ftp://b.net?q", "http://c.b.net/p", "http://x.org/http://a.com/x"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate([*urls, urls[5]])], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.match_rules(pages, rules).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("com", "/", "com/", "allow"), 4: ("com", "", None, "allow"),
        5: ("q.a.com", "/x", "a.com/x", "block"), 6: ("a.com", "/xyz", "a.com/x", "block"), 7: ("a.com", "/x/y/z", "a.com/x/y/", "allow"), 8: ("ba.com", "/x", "com/", "allow"),
        9: ("b.net", "", "b.net", "block"), 10: ("c.b.net", "/p", "b.net", "block"), 11: ("x.org", "/http://a.com/x", None, "allow"), 12: ("q.a.com", "/x", "a.com/x", "block"),
    }


def test_stages_keep_no_shuffle_files(spark):
    """A query of a stage leaves no shuffle files, though its table is still held; the session's setting is put back."""
    of_shuffles = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before, key = of_shuffles(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key)
    with stage(spark):
        grouped = spark.range(10_000).groupBy((F.col("id") % 100).alias("key")).count()
        table = written(grouped)
        until = time.time() + 10
        while of_shuffles() - before and time.time() < until:
            time.sleep(0.2)
        assert not of_shuffles() - before
        assert table.count() == 100 == grouped.count()
    assert spark.conf.get(key) == kept


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs, after = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        from tallybook.llm.storage import written

        current = written(stage(spark, current, sf_dir))
        after[name] = current
    lines = {r["doc_id"]: r["text"] for r in after["line dedup"].collect()}
    ids = sorted(lines)
    found = brute_components([lines[k] for k in ids])
    assert {r["doc_id"] for r in after["n-gram Jaccard join"].collect()} == {ids[k] for k, (_, root) in found.items() if root == k}
    items = [word_shingles(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in after["n-gram Jaccard join"].collect() if any(10 * len(q & word_shingles(r["text"])) >= 8 * len(q) for q in items)}
    kept = {r["doc_id"] for r in after["benchmark decontamination"].collect()}
    assert leaked and not leaked & kept
    assert {r["doc_id"] for r in after["best-fit packing"].collect()} == kept
    assert after["benchmark decontamination"].columns == docs.columns
    assert len(kept) > 0.8 * docs.count()


def test_pipeline_of_odd_tables(spark, tmp_path, texts):
    """Nulls, repeated rows, clashing names and an empty table; columns of the input come through every stage but the last."""
    import corpus_pipeline

    word = _own(50)
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 3 == 0 else f"s{k % 4}", len(t or ""), 7, "mine") for k, t in enumerate([*(word(60) for _ in range(40)), None, "", "one"])]
    table = spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string, lang string, source string, n_chars bigint, _lines int, dropped string")
    bench = spark.createDataFrame([(1, " ".join(rows[3][1].split()[5:40])), (2, None)], "item_id bigint, text string")
    for name, docs in (("odd", table), ("empty", table.where("false"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    current = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        from tallybook.llm.storage import written

        current = written(stage(spark, current, f"{tmp_path}/odd"))
        assert current.columns == table.columns
    final = current.collect()
    assert all((r["_lines"], r["dropped"]) == (7, "mine") for r in final)
    assert {r["doc_id"] for r in final} == {*range(40), 42} - {3} and len(final) == 44
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
