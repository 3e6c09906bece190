"""Resampling, the conversation trie and substring dedup against brute force on small fixtures with every edge case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tallybook.llm import op11, op12, op13
from tallybook.llm.conversation_trie import coded_turns, prefix_trie, with_shared_heads
from tallybook.llm.importance_resampling import resampled
from tallybook.llm.quickselect import first_in_order, kth_key
from tallybook.llm.repeated_passages import stretches, without_repeats
from tallybook.llm.storage import written

DOCS = "doc_id bigint, text string, spans string, seed string, rank string, least string, key string, body string"


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, *"clash"[:6].ljust(6, "x")) for k, t in rows], DOCS)


# Substring dedup


def brute_repeats(rows, length):
    least = {}
    cut = [(k, (t or "").encode().split()) for k, t in rows]
    for k, words in cut:
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            if k is not None:
                least[w] = min(k, least.get(w, k))
    for k, words in cut:
        gone = set()
        for i in range(len(words) - length + 1) if k is not None else ():
            if least[tuple(words[i : i + length])] < k:
                gone.update(range(i, i + length))
        kept = b" ".join(w for n, w in enumerate(words) if n not in gone)
        yield k, len(words), len(gone), hashlib.sha256(kept).hexdigest()


def got_repeats(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def repeat_rows():
    rng = random.Random(13)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40))
    passage = [word() for _ in range(70)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (None, " ".join(passage)), (None, " ".join(passage))]
    rows += [(3, " ".join(passage)), (3, " ".join(passage)), (3, " ".join([word(), *passage]))]
    for k in range(4, 40):  # the passage whole, cut short on either side, just long enough and just too short
        a, b = sorted((rng.randrange(12), 70 - rng.randrange(12)))
        rows.append((k, " ".join([word() for _ in range(rng.randrange(30))] + passage[a:b] + [word() for _ in range(rng.randrange(30))])))
    rows += [(40, " ".join(passage[:50])), (41, " ".join(passage[:49])), (42, "　".join(passage)), (43, " ".join(passage).upper())]
    base = [word() for _ in range(400)]
    for k in range(50, 80):  # edited copies
        copy = list(base)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randrange(2)] = [word()] * rng.randrange(3)
        rows.append((k, "  ".join(copy)))
    rows += [(80, "x " * 300), (81, "x " * 55 + "y"), (82, "x y " * 80), (83, "y x " * 80)]  # ties between seeds
    return rows + [(90 + k, t) for k, (_, t) in enumerate(rows[20:30])] + rows[20:30]


def test_repeats_against_brute_force(spark, repeat_rows):
    assert got_repeats(without_repeats(docs_of(spark, repeat_rows))) == sorted(brute_repeats(repeat_rows, 50), key=repr)


def test_repeats_of_other_lengths(spark, repeat_rows):
    rows = repeat_rows[:60]
    assert got_repeats(without_repeats(docs_of(spark, rows), length=7)) == sorted(brute_repeats(rows, 7), key=repr)


def test_repeats_are_spans_and_texts(spark):
    shared = " ".join(f"w{k}" for k in range(60))
    got = {r.doc_id: r for r in without_repeats(docs_of(spark, [(1, shared), (2, f"before {shared} after"), (3, f"{shared} {shared}")])).collect()}
    assert (got[1].n_removed, got[1].kept) == (0, shared)
    assert ([tuple(s) for s in got[2].spans], got[2].kept) == ([(1, 61)], "before after")
    assert (got[3].n_removed, got[3].kept) == (120, "")


def test_repeats_with_shuffled_lists(spark, repeat_rows, monkeypatch):
    monkeypatch.setattr("tallybook.llm.repeated_passages.BROADCAST_ENTRIES", 0)
    assert got_repeats(without_repeats(docs_of(spark, repeat_rows))) == sorted(brute_repeats(repeat_rows, 50), key=repr)


def test_repeats_of_nothing(spark):
    assert without_repeats(docs_of(spark, [])).count() == 0
    assert [r.n_removed for r in without_repeats(docs_of(spark, [(1, None)])).collect()] == [0]


def test_seeds_of_a_long_text_are_few():
    rng = random.Random(3)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(1_000_000)).encode()
    seed, _, _, start, stop = stretches(text, 50, 10)
    assert 30_000 < len(seed) < 60_000 and start[0] == 0 and stop[-1] == 1_000_000
    assert (start[1:] + 49 == stop[:-1]).all()


# Resampling


def brute_resampled(rows, target, percent=25):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    features = lambda ws: [zlib.crc32(f.encode()) % 10000 for f in ws + [" ".join(p) for p in zip(ws, ws[1:])]]
    s, t = (Counter(b for x in texts for b in features(cut(x))) for texts in ([x for _, x in rows], target))
    n_s, n_t = sum(s.values()) + 10000.0, sum(t.values()) + 10000.0
    out = []
    for k, x in rows:
        found = features(cut(x))
        total = sum(math.floor(1000 * math.log((t[b] + 1.0) * n_s / ((s[b] + 1.0) * n_t))) for b in found)
        weight = total // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{k}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) if k is not None else None
        out.append([k, len(found), weight, score, None, len(cut(x))])
    fit = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for place, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got_resampled(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def sampled_rows():
    rng = random.Random(11)
    rows = [(0, None), (1, ""), (2, "..."), (3, "one"), (None, "w " * 30), (None, None), (4, "Ünï Çode ÄB c 1-2_3 " * 8), (5, "A b C " * 7)]
    rows += [(k, " ".join(rng.choice(["the", "of", "cat", "Dog", "x1", "naïve", "日本"]) for _ in range(rng.randrange(40)))) for k in range(6, 160)]
    return rows + rows[20:26] + [(200, "same text " * 15)] * 30 + [(300, "k " * 200_000)]


def test_resampling_against_brute_force(spark, sampled_rows):
    target = [None, "the cat", "of the Dog x1"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert got_resampled(resampled(docs_of(spark, sampled_rows), bench)) == brute_resampled(sampled_rows, target)


@pytest.mark.parametrize("percent", [0, 100])
def test_resampling_none_and_all(spark, sampled_rows, percent):
    rows = sampled_rows[:60]
    assert got_resampled(resampled(docs_of(spark, rows), spark.createDataFrame([], "text string"), percent)) == brute_resampled(rows, [], percent)


def test_resampling_of_nothing(spark):
    assert resampled(docs_of(spark, []), spark.createDataFrame([("a b",)], "text string")).count() == 0


def test_kth_key_with_ties(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5), rng.randrange(4)) for _ in range(400)] + [(2, 2)] * 300
    table = written(spark.createDataFrame(rows, "a bigint, b bigint"))
    for k in (1, 2, 77, 350, 500, 699, 700):
        assert kth_key(table, ["a", "b"], k) == sorted(rows)[k - 1]
    assert kth_key(table, ["a", "b"], 0) is None and kth_key(table, ["a", "b"], 701) is None
    got = [(r["rank"], (r.a, r.b)) for r in first_in_order(table, ["a", "b"], 350, F.lit(True)).collect()]
    assert sorted(g for g in got if g[0]) == list(enumerate(sorted(rows)[:350], 1)) and len(got) == 700


# Conversation trie


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        inner = {n[:-1] for n in members if n}
        ends = ",".join(str(c) for c in sorted(cs) if rebuilt[c] == node)
        yield (
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(n[:-1] == node for n in members if n), sum(n not in inner for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        )


def rebuilt_of(spark, rows):
    table = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, key string, id int")
    c = F.col("conv_id")
    return with_shared_heads(coded_turns(table), c - c % 100, F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(6)).cast("int"), 5)


@pytest.fixture(scope="module")
def conversation_rows():
    rng = random.Random(12)
    texts = ["", "hi", "héllo 日本", "x" * 500, None, "a", "b"]
    rows = [(None, 1, "user", "no conversation"), (7, None, None, "first"), (7, 0, "user", None), (7, 0, "user", ""), (7, 0, "a", "tie"), (7, 0, "a", "tie")]
    for c in [*range(60), *range(100, 130), *range(205, 240), 300, 400, 401]:
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(texts)) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", f"common {t}") for c in range(500, 560) for t in range(4)]
    return rows + [(601, t, "user", f"deep {t}") for t in range(40)]


@pytest.mark.parametrize("shard_turns", [200_000, 40, 7])
def test_trie_against_brute_force(spark, conversation_rows, shard_turns):
    got = prefix_trie(rebuilt_of(spark, conversation_rows), shard_turns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_trie(conversation_rows), key=repr)


def test_trie_of_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr("tallybook.llm.conversation_trie.CHUNK", 20)
    rows = [(100 * c, t, "user", f"turn {t}") for c in range(300) for t in range(2)]
    assert sorted(map(tuple, prefix_trie(rebuilt_of(spark, rows), 50).collect()), key=repr) == sorted(brute_trie(rows), key=repr)


def test_trie_of_turnless_and_nothing(spark):
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0)
    assert [tuple(r) for r in prefix_trie(rebuilt_of(spark, [(turnless, 0, "user", "gone")])).collect()] == list(brute_trie([(turnless, 0, "user", "gone")]))
    assert prefix_trie(rebuilt_of(spark, [])).count() == 0


@pytest.mark.parametrize("query, oracle", [(op11.op11_importance_resampling, op11.ORACLE), (op12.op12_conversation_trie, op12.ORACLE), (op13.op13_substring_dedup, op13.ORACLE)])
def test_queries_against_sql(spark, sf_dir, query, oracle):
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    df, result = query(spark, sf_dir), connection.sql(oracle)
    columns = sorted(df.columns)
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(row[k] for k in places) for row in result.fetchall()), key=repr)
