"""Operators that judge rows one by one, against brute force, round trips and hand-written cases."""

import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallybook.llm import language_mixture, license_scan, line_blocks, media, shingles, tiff
from tallybook.llm.balanced_tree import BalancedTree
from tallybook.llm.license_templates import TEMPLATES

ODD_TEXTS = [None, "", "   ", "\n\n", "a", "été " * 2000, "x" * 30000, "mit license " * 500, "same text", "same text"]


def frame(spark, texts, extra=""):
    rows = [(k, t, "en", "s", 1, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, dropped string")


# 1: media


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("layout", [{}, {"predictor": 2}, {"tile": 64}, {"tile": 16, "predictor": 2}, {"rows": 3}])
def test_tiff_round_trip(compression, layout):
    for text in ("", "abc" * 90, "héllo wörld " * 700, "a" * 5000):
        data = media.payload(text)[1]
        image = np.frombuffer(data, np.uint8).reshape(-1, 64)
        pages = list(tiff.read_pages(tiff.write_tiff([{"samples": image, "compression": compression, **layout}] * 2)))
        assert [p["page"] for p in pages] == [0, 1]
        assert all(p["samples"].tobytes() == data for p in pages)


def test_tiff_big_endian_16_bit():
    import struct

    samples = np.array([[1, 300], [70, 65535]], ">u2")
    tags = [(256, 3, 2), (257, 3, 2), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 8), (278, 3, 2), (279, 4, 8)]
    entries = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags)
    data = b"MM\0*" + struct.pack(">I", 16) + samples.tobytes() + struct.pack(">H", len(tags)) + entries + b"\0\0\0\0"
    assert next(tiff.read_pages(data))["samples"][:, :, 0].tolist() == samples.tolist()


def test_media_rows(spark):
    stored = media.store_texts(frame(spark, ODD_TEXTS))
    rows = {r["doc_id"]: r for r in media.tiff_pages(stored).collect()}
    for k, text in enumerate(ODD_TEXTS):
        data = (text or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (rows[k]["n_bytes"], bytes(rows[k]["samples"])) == (len(data), padded)
    assert rows[8]["media"] == rows[9]["media"]
    broken = spark.createDataFrame([(1, 0, b"no image"), (2, 0, None)], "doc_id bigint, n_bytes bigint, media binary")
    (row,) = media.tiff_pages(broken).collect()
    assert row["page"] is None and "TIFF" in row["error"]


def test_op1_digests(spark, sf_dir):
    from tallybook.llm.op1 import op1_media_columns

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op1_media_columns(spark, sf_dir).collect():
        data = media.payload(texts[r["doc_id"]])[1]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))


# 6: licenses


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), sorted(found)


def test_license_base(spark, sf_dir):
    texts = ODD_TEXTS + ["MIT License. mit LICENSE; CC-BY cc by, Apache-License", "GNU General\nPublic  License gnu general public licenses", "écc by"]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for text in texts:
        assert license_scan.scan(text)[:2] == brute_licenses(text)
    row = license_scan.scan_licenses(frame(spark, texts[:11])).where("doc_id = 10").first()
    assert (row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (5, 0, 8, "apache,cc-by,mit")


def test_license_templates():
    labels = lambda text: [x for x, _, _ in license_scan.scan(text)[2]]
    for name, template in TEMPLATES.items():
        plain = re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", template, flags=re.S)
        plain = re.sub(r"<<var;words=(\d+)-\d+>>", lambda m: "w " * int(m[1]), plain)
        assert name in labels("before " + plain + " after"), name
        words = plain.split()
        assert name not in labels(" ".join(words[:-1])), name
        full = re.sub(r"<<(beginOptional|endOptional)>>", "", template)
        full = re.sub(r"<<var;words=\d+-(\d+)>>", lambda m: "w " * int(m[1]), full)
        assert name in labels(full.upper()), name
    assert labels("neither the name of " + "w " * 13 + "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission") == []


def test_license_wording_is_mandatory():
    scan = license_scan.scan
    bsd = re.sub(r"<<(?:begin|end)Optional>>", "", re.sub(r"<<var;words=[0-9-]+>>", "the authors", TEMPLATES["bsd-3-clause"]))
    assert [x for x, _, _ in scan(bsd)[2]] == ["bsd-3-clause"]
    without = bsd[: bsd.index("this software is provided")]
    assert scan(without + "all advertising materials must display an acknowledgement")[2] == []
    assert scan(bsd.replace("profits", "gains"))[2] == []
    rows = [list(license_scan._row(1, t))[0][7] for t in (bsd, "released under the MIT License", "an Apache License", "none", None)]
    assert rows == [1.0, 0.75, 0.5, 0.0, 0.0]


# 5: HTML


def test_main_text_regions():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
      <div class="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; more</h1></header><p>First
      para&shy;graph <b>bold</b>.<p>Second<br>line<script>var t = "</p>";</script> end.<div class="ad">Buy</div><aside>Side</aside><ul><li>item</li></ul>
      <form><input><p>Name</p></form><p>Last &#233;&nbsp;x.</p></article><section id="comments"><p>Nice post</p></section></main><footer>&copy; x</footer></body>"""
    assert line_blocks.main_text(page) == "Title & more\nFirst para\xadgraph bold.\nSecond line end.\nitem\nLast é x."


def test_main_text_without_article():
    body = "".join(f"<div><p>Paragraph {k} of the story, long enough to count as text of an article.</p></div>" for k in range(4))
    menu = "".join(f"<a href='/{k}'>Link {k}</a> " for k in range(9))
    page = f"<body><div>{menu}</div><div class='sidebar'><p>{'side ' * 60}</p></div>{body}<div id=footer><p>Contact us here</p></div></body>"
    assert line_blocks.main_text(page) == "\n".join(f"Paragraph {k} of the story, long enough to count as text of an article." for k in range(4))
    assert [line_blocks.main_text(p) for p in (None, "", "<nav>a</nav>", "<p>", "<article>", "<!-- x")] == [""] * 6
    assert line_blocks.main_text("<p>short</p>") == "short"
    assert line_blocks.main_text('<main><p>a</p><div hidden>b</div><p style="display: none">c<p>d</p><div role=contentinfo>e</div></main>') == "a\nd"
    assert line_blocks.main_text("<article><p>cut off in mid <b") == "cut off in mid"


def test_main_text_between_skipped_markup():
    a, b, c = (f"Paragraph {x} of the story, long enough to count as text of an article by itself, whatever stands beside it." for x in "ABC")
    page = f"<body><nav><p>{a}</p></nav><div id=content><p>{a}</p><div class=ad>Buy</div><p>{b}</p><aside>Side</aside><div><p>{c}</p></div></div><footer>x</footer><p>{a[:90]}</p></body>"
    assert line_blocks.main_text(page) == f"{a}\n{b}\n{c}"
    ad = "<div class=ad>Buy</div>"
    assert line_blocks.main_text(f"<div id=content><p>Lead.</p>{ad}<p>{a}</p>{ad}<p>{b}</p>{ad}<p>End.</p></div>") == f"Lead.\n{a}\n{b}\nEnd."


def test_main_text_of_links_in_article():
    links = "".join(f"<p><a href=/{k}>Link {k}</a></p>" for k in range(4))
    page = f"<article><h1><a href=/>Linked title</a></h1><p>Text.</p>{links}<p>More.</p><p><a href=/z>Last</a></p></article>"
    assert line_blocks.main_text(page) == "Linked title\nText.\nLink 0\nLink 1\nLink 2\nLink 3\nMore.\nLast"


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "with-comments", "nav-fixed", "content widget-area"])
def test_main_text_of_wrappers(name):
    assert line_blocks.main_text(f"<body><div class='{name}'><article><p>Text.</p></article></div></body>") == "Text."
    assert line_blocks.main_text(f"<body><div class='{name}'><p>Text.</p></div></body>") == "Text."


def test_main_text_of_marks():
    assert line_blocks.main_text("<body><div class=sidebar><main><p>Text.</p><p title='the hidden cost'>Cost.</p></main></div></body>") == "Text.\nCost."
    for name in ("ad", "ad-banner", "cookie-notice", "site-footer", "x sidebar", "share_buttons", "comments", "ad-728"):
        assert line_blocks.main_text(f"<main><p>Text.</p><div class='{name}'>No</div><p hidden>No</p><p style='color: red; display:none'>No</p></main>") == "Text.", name


A, B, C = (f"{x} " + "is a paragraph of the story, long enough to be told from a menu or a notice by its length alone." for x in ("One", "Two", "Three"))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1><a href=/>Headline</a></h1><p>Body</p><p><a href=/>Last</a></p></article>", "Headline\nBody\nLast"),
        ('<article><p>One.</p><section id="related-work"><p>Work.</p></section><table class="share-price"><tr><td>5</table><p data-id="search-1">Two.</p></article>', "One.\nWork.\n5\nTwo."),
        ("<article><p>One.</p><ul><li class=share>Share<li>Item</ul><p>Two.</p></article>", "One.\nItem\nTwo."),
        ("<body><nav><ul><li>Menu<article><p>Text.</p></article></body>", "Text."),
        (f"<body><article><p>{A}</p></article><p>x</p><article><p>{B}</p></article><article><p>No</p></article></body>", f"{A}\n{B}\nNo"),
        (f"<div id=content><p>{A}</p><ul><li><a>a</a><li><a>b</a><li><a>c</a><li><a>d</a></ul><p>{B}</p></div>", f"{A}\n{B}"),
        ('<p>One <a href="x>y</a> two.', "One y two."),
        ("<p>1 < 2 and 3 > 2 &amp; a<b", "1 < 2 and 3 > 2 & a"),
        (f"<form id=all><div><p>{A}</p><p>{B}</p></div></form>", f"{A}\n{B}"),
        (f"<div><p>{A}<p>{B}</div><form><p>Name <input></p></form><div class='comment-list'><p>{C}</p><p>{C}</p></div>", f"{A}\n{B}"),
        ("<article><dl><dt>T<dd>D<dt>U</dl><table><tr><td>1<td>2<tr><td>3</table></article>", "T\nD\nU\n1\n2\n3"),
        ("<article><script>if (a < b) '</p>'</script><p>x<style>y</style>z</article><textarea>", "xz"),
        ("<article><p>a</p><article class=comment><p>b</p></article><p>c</p></article>", "a\nc"),
    ],
)
def test_main_text_of_fixtures(page, text):
    assert line_blocks.main_text(page) == text


@pytest.mark.parametrize("piece", ["<x ", '<x "', "<a href='", "<", "<!--", "<p><b>", "<div class=a", "</p x=", "<script>", "&amp", "<nav>", "<li>x", "<a b= ", "<table><td>"])
def test_broken_markup_in_linear_time(piece):
    page = '"' + piece * (300_000 // len(piece)) if piece != '<x "' else piece + "<x " * 100_000
    began = time.process_time()
    line_blocks.main_text(page)
    assert time.process_time() - began < 6


def test_pages_of_any_kind(spark):
    rows = [(1, "u", None, "n"), (2, None, "", "n"), (3, "u", f"<p>{A}</p>" * 20_000, "n"), (3, "u", f"<p>{A}</p>" * 20_000, "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    assert sorted((r["page_id"], r["n_chars"]) for r in line_blocks.extract_main_text(pages).collect()) == [(1, 0), (2, 0)] + [(3, 20_000 * (len(A) + 1) - 1)] * 2
    assert line_blocks.extract_main_text(pages.where("false")).count() == 0


LONG = "A long paragraph of the story which is long enough to count as text of an article, really, and says so twice."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><nav><a>Menu</a><div><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),  # a menu that is never closed
        (f"<body><div><p>{LONG}</p><ul><li><a>1</a></li><li><a>2</a></li><li><a>3</a></li><li><a>4</a></li></ul><p>End.</p></div></body>", f"{LONG}\nEnd."),
        (f"<body><p>{LONG}</p>" + "<p><a>link</a></p>" * 5 + f"<p>{LONG}</p></body>", f"{LONG}\n" + "link\n" * 5 + LONG),
        (f"<article><h2 class=menu>Menu of the day</h2><p>{LONG}</p><p class=login>Login is hard.</p><p class=ad>Buy</p></article>", f"Menu of the day\n{LONG}\nLogin is hard."),
        ("<article><p><a href=x>Only a link</a></p></article>", "Only a link"),
        (f"<article><p>{LONG}</p></article><article><p>Short.</p></article>", f"{LONG}\nShort."),
        ("<body><nav>Home Menu words here</nav>" + "<div>" * 2000 + f"<p>{LONG}</p>" + "</div>" * 2000, LONG),
        (f"<body><div><ul><li><a>Home</a></li><li><a>News</a></li></ul><div><p>{LONG}</p></div></div></body>", LONG),  # an unmarked menu before the text
    ],
)
def test_main_text_by_distribution(page, text):
    assert line_blocks.main_text(page) == text


def test_distribution_decides_on_every_page(spark, sf_dir, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    asked, spans_of = [], line_blocks.spans_of
    monkeypatch.setattr(line_blocks, "spans_of", lambda *a: asked.append(1) or spans_of(*a))
    texts = [line_blocks.main_text(p) for p in pages]
    assert len(asked) == len(pages)
    bare = [re.sub(r"</?article>", "", p).replace('<div class="ad">', "<div>") for p in pages]  # no element tells the text any more

    def largest_span(page):
        """The text between surge and dive, from the definition, over the page's lines outside menus and footers."""
        lines = [(re.sub(r"\s+", " ", re.sub(r"<[^>]*>", "", x)).strip()) for x in re.split(r"</?(?:h1|p|div|body)[^>]*>", re.sub(r"(?s)<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->|.*</head>", "<p><p><p><p>", page))]
        return [html.unescape(x) for x in lines if x]

    got = [line_blocks.main_text(p) for p in bare]
    assert sum(set(largest_span(p)) >= set(g.split("\n")) for p, g in zip(bare, got)) > 0.9 * len(pages)
    assert sum(t in g for t, g in zip(texts, got)) > 0.9 * len(pages)
    monkeypatch.setattr(line_blocks, "SURGE", 10**9)
    assert [line_blocks.main_text(p) for p in pages] == texts  # the page's own highest sum bounds the threshold


def test_window_and_threshold_change_what_is_kept(monkeypatch):
    page = f"<body><div><p>{LONG}</p></div><div><p>one</p><p><a>x</a></p><p><a>y</a></p><p><a>z</a></p></div><div><p>{LONG[:60]}</p><p>{LONG[60:]}</p></div></body>"
    usual = line_blocks.main_text(page)
    assert usual.count("\n") >= 2
    kept = {}
    for name, value in (("SURGE", 1), ("WINDOW", 1)):
        with monkeypatch.context() as m:
            m.setattr(line_blocks, name, value)
            kept[name] = line_blocks.main_text(page)
    assert "one" in kept["SURGE"] and kept["WINDOW"] != kept["SURGE"]


def test_main_text_of_pages(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r["page_id"]: r for r in line_blocks.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    for page in pages:
        blocks = re.split(r"</?(?:p|h\d)>", re.search(r"<article>(.*?)</article>", page["html"], re.S)[1])
        plain = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", " ", b))).strip() for b in blocks]
        assert got[page["page_id"]]["text"] == "\n".join(b for b in plain if b)


# 10: language


def test_language_held_out(spark, sf_dir):
    from tallybook.llm.op10 import op10_language_id

    docs = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    rows = op10_language_id(spark, f"{sf_dir.rsplit('/', 1)[0]}/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98


def test_language_mixture(spark):
    rng = random.Random(3)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(k, make("abcde" if k % 2 else "vwxyz", 60), "aa" if k % 2 else "zz") for k in range(60)] + [(90, None, "aa"), (91, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_mixture.train(docs)
    assert model[0] == ["aa", "zz"]
    asked = [None, "", "123 !!", "—", make("abcde", 30), make("abcde", 30) + " " + make("vwxyz", 60), make("vwxyz", 1) + " " + make("abcde", 200)]
    got = {r["doc_id"]: r for r in language_mixture.identify(frame(spark, asked), model).collect()}
    assert [got[k]["lang_pred"] for k in range(7)] == ["und"] * 4 + ["aa", "zz", "aa"]
    assert set(got[5]["shares"]) == {"aa", "zz"} and 0.6 < got[5]["score"] < 0.75 and set(got[4]["shares"]) == {"aa"}
    nothing = language_mixture.train(docs.where("false"))
    assert language_mixture.identify(frame(spark, ["abc"]), nothing).first()["lang_pred"] == "und"
    kept = language_mixture.keep_identified(frame(spark, asked), model, 0.4)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6] and kept.columns == frame(spark, asked).columns


def plain_mixture(loglik, members, rounds=400):
    """EM over words with plain loops."""
    share = {m: 1 / len(members) for m in members}
    for _ in range(rounds):
        posteriors = []
        for row in loglik:
            top = max(row[m] for m in members)
            weights = {m: share[m] * np.exp(row[m] - top) for m in members}
            posteriors.append({m: w / sum(weights.values()) for m, w in weights.items()})
        share = {m: sum(p[m] for p in posteriors) / len(posteriors) for m in members}
    value = sum(np.log(sum(share[m] * np.exp(row[m] - max(row)) for m in members)) + max(row) for row in loglik)
    return share, value


def test_language_mixture_brute():
    """EM and the choice of the set against plain loops and all subsets."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    for true, words in (([0], 40), ([1, 2], 80), ([0, 1, 2, 3], 200), ([3], 3)):
        loglik = rng.normal(-30, 1, (words, 4))
        for k in range(words):
            loglik[k, true[k % len(true)]] += 8
        share, value = language_mixture.mixture(loglik, np.array(true))
        plain, plain_value = plain_mixture(loglik, true)
        assert all(abs(share[k] - plain[m]) < 0.01 for k, m in enumerate(true)) and abs(value - plain_value) < 0.1
        cost = language_mixture.PENALTY * 0.5 * np.log(words + 1)
        best = max((s for n in range(1, 5) for s in combinations(range(4), n)), key=lambda s: plain_mixture(loglik, s, 60)[1] - cost * len(s))
        members, _ = language_mixture.language_set(loglik)
        assert sorted(members.tolist()) == sorted(best)
        assert abs(language_mixture.certainty(loglik, 0) - sum(np.exp(r[0]) / np.exp(r).sum() for r in loglik) / words) < 1e-9


def test_language_many_labels_ties_and_long_texts(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 5, f"l{k:03}") for k in range(300)]
    model = language_mixture.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model[1].size <= language_mixture.MODEL and 200 < len(model[0]) <= 300
    twins = [(k, "same words in both", "bb" if k % 2 else "aa") for k in (1, 3, 4, 6, 8, 9) * 2]
    model = language_mixture.train(spark.createDataFrame(twins, "doc_id bigint, text string, lang string"))
    model = (model[0], np.repeat(model[1][:, :1], len(model[0]), axis=1))
    got = language_mixture.identify(frame(spark, ["same words", "same words", "words " * 100_000]), model).collect()
    assert [r["lang_pred"] for r in got] == ["aa"] * 3


# shingles and trees


def test_shingle_sets():
    rng = random.Random(1)
    texts = [None, "", " ", "a", "A", "a b", "B a", "one two three four five", "x " * 50] + [" ".join(rng.choice(["ab", "cd", "éè", "É", "\tq\n"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    for array in (pa.array(texts), pa.array(texts).slice(3, 40), pa.array([], pa.string())):
        pairs = [(plain(t), set(h.tolist())) for t, h in zip(array.to_pylist(), shingles.shingle_sets(array), strict=True)]
        assert all(len(a) == len(b) for a, b in pairs)
        for _ in range(500 if pairs else 0):
            (a, x), (b, y) = rng.choice(pairs), rng.choice(pairs)
            assert len(a & b) == len(x & y)


def test_balanced_tree():
    rng, keys = random.Random(2), set()
    tree = BalancedTree()
    for _ in range(2000):
        k = rng.randint(0, 300)
        if k in keys:
            tree.remove(k)
            keys.remove(k)
        else:
            tree.insert(k)
            keys.add(k)
        ask = rng.randint(0, 300)
        assert tree.successor(ask) == min((x for x in keys if x >= ask), default=None)
        assert tree.largest() == max(keys, default=None)


def test_word_likelihoods_in_pieces(monkeypatch):
    """The same sums whatever is looked up at once; a text under many labels takes memory by its words."""
    rng = np.random.default_rng(3)
    table = rng.normal(size=(1024, 5)).astype(np.float32)
    text = " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 12))) for _ in range(500)) + " " + "x" * 900
    ids, starts = language_mixture.trigram_buckets(text)
    whole = language_mixture.word_likelihoods(table, ids, starts)
    for at_once in (1, 7, 100, 10**6):
        monkeypatch.setattr(language_mixture, "AT_ONCE", at_once)
        assert np.allclose(language_mixture.word_likelihoods(table, ids, starts), whole, atol=1e-3)
