"""Articles (documents) and pages: classification, gazetteer, headlines, markup, anti and semi joins on text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.dictionaries import BATCH_CATEGORIES, FEED_CATEGORIES, RED_CATEGORIES
from tallybook.functions.bands import severity
from tallybook.functions.text import content_key, csv_field, headline, slug, text_key, unescaped, without_tags
from tallybook.operators.classify import ISSUE_AGENCIES, agency, gazetteer, keyword_category, moderation_status, one_row_per_place
from tallybook.operators.dedup import keep_first_text, new_by_text
from tallybook.operators.gazetteer import first_place, outermost, place_hits, places_in_order
from tallybook.operators.joins import with_any_first_word
from tallybook.session import table, written
from tallybook.sources.markup import links, tag_texts

# Terms that occur in the test texts, so that the classifier has something to find.
CATEGORIES = {"LEGAL": ["license", "rights reserved", "copyright"], "CONTACT": ["@", "http", "call"], "PROSE": ["the ", "les ", "der ", "las "], "NOISE": ["###", "$$$", "!!"]}
RED = ["LEGAL", "CONTACT"]
PLACES = [("tion", 1), ("ment", 2), ("heit", 3), ("ción", 4), ("tionth", 1), ("mentre", 2), ("the and", 5), ("license", 6), ("apache", 6)]
SITES = [("blog.", 1), ("example.org", 2), ("www.", 3), ("/fr/", 4), ("tion", 5), ("ment", 1), ("the", 6), ("ung", 7), ("tionth", 8)]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def keyword_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and severity of every document."""
    category = keyword_category(F.col("text"), CATEGORIES)
    return _documents(spark, sf_dir).select("doc_id", category.alias("category")).withColumn("severity", severity(F.col("category"), RED))


PHRASES = sorted({k for words in (*BATCH_CATEGORIES.values(), *FEED_CATEGORIES.values()) for k in words})


def story_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories made of events, a phrase in the title and two in the body, under the dictionaries of the batch run and of the feed."""
    phrase = lambda step: F.element_at(F.array(*(F.lit(p) for p in PHRASES)), (F.pmod(F.col("event_id") * step, F.lit(len(PHRASES))) + 1).cast("int"))
    stories = table(spark, sf_dir, "events").select("event_id", F.initcap(phrase(1)).alias("title"), F.when(F.col("event_id") % 5 != 0, F.concat(phrase(7), F.lit(" and "), phrase(11))).alias("body"))
    both = F.concat_ws(" ", "title", "body")
    told = stories.select(keyword_category(both, BATCH_CATEGORIES).alias("batch"), keyword_category(both, FEED_CATEGORIES).alias("feed"))
    return told.withColumn("severity", severity(F.col("feed"), RED_CATEGORIES)).groupBy("batch", "feed", "severity").agg(F.count("*").alias("n"))


def gazetteer_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each of its places, one row per place; documents without any keep a row."""
    docs = _documents(spark, sf_dir)
    hits = place_hits(docs, gazetteer(spark, PLACES), "doc_id", "text")
    return one_row_per_place(docs.select("doc_id"), hits, "doc_id")


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five letters and more and pairs of words of the benchmark as a gazetteer of 238 places; declared in the order of a digest."""
    words = F.split(F.lower("text"), " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.concat(words[k - 1], F.lit(" "), words[k]))
    found = table(spark, sf_dir, "benchmark").where(F.contains("text", F.lit(" "))).select(F.explode(F.concat(words, pairs)).alias("alias")).where("length(alias) >= 5").distinct()
    number = lambda a, b: F.conv(F.substring(F.md5("alias"), a, b), 16, 10).cast("bigint")
    return found.select("alias", (number(1, 6) % 238).cast("int").alias("place"), number(7, 8).alias("ordinal"))


def gazetteer_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of every document under a gazetteer of many hundred aliases: how many, the first, and which alias names each."""
    hits = place_hits(_documents(spark, sf_dir), _aliases(spark, sf_dir), "doc_id", "text")
    return hits.select("doc_id", "place", "alias")


def gazetteer_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the longest alias naming a place, and only aliases within no longer one."""
    hits = place_hits(_documents(spark, sf_dir), _aliases(spark, sf_dir), "doc_id", "text", rule="longest")
    return outermost(hits, "doc_id").groupBy("doc_id").agg(F.count("*").alias("places"), F.max(F.length("alias")).alias("longest"))


def signal_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as signals: places of the title, a hint (the url) before them; the single place and all in order."""
    title = F.get(tag_texts(F.col("html"), "title"), F.lit(0))
    signals = table(spark, sf_dir, "pages").select("page_id", "url", title.alias("title"))
    hits = written(place_hits(signals, gazetteer(spark, SITES), "page_id", "url", "title"))
    return first_place(hits, "page_id").join(places_in_order(hits, "page_id"), "page_id").select("page_id", "place", "alias", F.array_join("places", ",").alias("places"))


def dedup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each normalised beginning."""
    return keep_first_text(_documents(spark, sf_dir).where("text IS NOT NULL"), "text", ["doc_id"]).select("doc_id", "text_key")


def unseen_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of one source whose beginning no other source has."""
    docs = _documents(spark, sf_dir)
    return new_by_text(docs.where("source = 'src0'"), docs.where("source <> 'src0'"), "text", ["doc_id"]).select("doc_id", "text_key")


def semi_by_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the first word of a benchmark item."""
    return with_any_first_word(_documents(spark, sf_dir).select("doc_id", "text"), "text", table(spark, sf_dir, "benchmark"), "text").select("doc_id")


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title of each page, cleaned for a headline, as slug and as keys."""
    title = F.get(tag_texts(F.col("html"), "title"), F.lit(0))
    titled = table(spark, sf_dir, "pages").select("page_id", title.alias("title"))
    return titled.select("page_id", "title", headline(F.col("title")).alias("headline"), text_key(F.col("title")).alias("text_key"), content_key(F.col("title")).alias("content_key"), csv_field(F.col("title")).alias("csv"))


def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items and anchors of each page."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.size(tag_texts(F.col("html"), "li")).cast("bigint").alias("items"), F.array_join(links(F.col("html")), " ").alias("links"))


def stripped_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each page without tags."""
    return table(spark, sf_dir, "pages").select("page_id", F.length(without_tags(F.col("html"))).cast("bigint").alias("n"), F.length(unescaped(F.col("html"))).cast("bigint").alias("plain"))


def moderated_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as reports: status from stand-ins for what a model would say, and the agency of an issue."""
    turns = table(spark, sf_dir, "conversations")
    confidence = F.pmod(F.length("text"), F.lit(100))
    status = moderation_status(F.contains("text", F.lit("!!")), F.col("role") != "system", F.col("role") == "user", confidence)
    issues = F.array(*(F.lit(k) for k in ISSUE_AGENCIES))
    issue = F.get(issues, F.pmod("turn", F.lit(len(ISSUE_AGENCIES) + 1)).cast("int"))
    return turns.select("conv_id", "turn", "role", status.alias("status"), agency(issue).alias("agency")).groupBy("role", "status", "agency").agg(F.count("*").alias("n"))


def source_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source and language, keyed by a slug."""
    label = F.concat_ws(" / ", "source", "lang")
    return _documents(spark, sf_dir).groupBy(slug(label).alias("slug")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


def _score(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in words)


ALIASES_SQL = """
cut AS (SELECT string_split(lower(text), ' ') AS w FROM benchmark WHERE contains(text, ' ')),
found AS (SELECT DISTINCT unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS alias FROM cut),
names AS (SELECT alias, CAST(CAST('0x' || md5(alias)[1:6] AS BIGINT) % 238 AS INT) AS place, CAST('0x' || md5(alias)[7:14] AS BIGINT) AS ordinal FROM found WHERE length(alias) >= 5)"""
KEY_SQL = "substr(trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), 1, 60)"
TITLE_SQL = """
raw AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS r FROM pages),
titled AS (SELECT page_id, replace(replace(replace(replace(replace(replace(r, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS title FROM raw)"""

QUERIES = {
    f.__name__: f
    for f in (keyword_classes, story_classes, gazetteer_fanout, gazetteer_large, gazetteer_longest, signal_places, dedup_text, unseen_articles, semi_by_word, page_titles, page_lists, stripped_chars, moderated_reports, source_slugs)
}
def _class_sql(categories: dict[str, list[str]]) -> str:
    """The category with most keywords in t, the first of equals."""
    scores = [" + ".join(f"contains(t, '{k}')::INT" for k in words) for words in categories.values()]
    return f"list_extract([{', '.join(repr(c) for c in categories)}], list_position([{', '.join(scores)}], nullif(list_max([{', '.join(scores)}]), 0)))"


ORACLES = {
    "story_classes": f"""
WITH p AS (SELECT [{", ".join(f"'{x}'" for x in PHRASES)}] AS ps),
t AS (SELECT lower(ps[event_id % {len(PHRASES)} + 1] || CASE WHEN event_id % 5 <> 0 THEN ' ' || ps[event_id * 7 % {len(PHRASES)} + 1] || ' and ' || ps[event_id * 11 % {len(PHRASES)} + 1] ELSE '' END) AS t FROM events, p),
c AS (SELECT {_class_sql(BATCH_CATEGORIES)} AS batch, {_class_sql(FEED_CATEGORIES)} AS feed FROM t)
SELECT batch, feed, CASE WHEN feed IN ({", ".join(f"'{x}'" for x in RED_CATEGORIES)}) THEN 'red' WHEN feed IS NOT NULL THEN 'yellow' END AS severity, count(*) AS n FROM c GROUP BY ALL""",
    "keyword_classes": f"""
WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
s AS (SELECT doc_id, {", ".join(f"{_score(w)} AS {k}" for k, w in CATEGORIES.items())} FROM l),
c AS (SELECT doc_id, CASE greatest({", ".join(CATEGORIES)}) WHEN 0 THEN NULL {" ".join(f"WHEN {k} THEN '{k}'" for k in CATEGORIES)} END AS category FROM s)
SELECT doc_id, category, CASE WHEN category IN ('LEGAL', 'CONTACT') THEN 'red' WHEN category IS NOT NULL THEN 'yellow' END AS severity FROM c""",
    "gazetteer_fanout": f"""
WITH names(ordinal, alias, place) AS (VALUES {", ".join(f"({k}, '{a}', {p})" for k, (a, p) in enumerate(PLACES))}),
hits AS (SELECT doc_id, place, alias, row_number() OVER (PARTITION BY doc_id, place ORDER BY ordinal) AS rn FROM documents JOIN names ON contains(lower(text), alias))
SELECT d.doc_id, place, alias FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id AND rn = 1""",
    "gazetteer_large": f"WITH {ALIASES_SQL} SELECT doc_id, place, arg_min(alias, (ordinal, alias)) AS alias FROM documents JOIN names ON contains(lower(text), alias) GROUP BY doc_id, place",
    "gazetteer_longest": f"""
WITH {ALIASES_SQL}, h AS (SELECT doc_id, place, arg_min(alias, (-length(alias), ordinal, alias)) AS alias FROM documents JOIN names ON contains(lower(text), alias) GROUP BY doc_id, place)
SELECT doc_id, count(*) AS places, max(length(alias)) AS longest FROM h WHERE NOT EXISTS (SELECT 1 FROM h l WHERE l.doc_id = h.doc_id AND length(l.alias) > length(h.alias) AND contains(l.alias, h.alias)) GROUP BY 1""",
    "signal_places": f"""
WITH names(ordinal, alias, place) AS (VALUES {", ".join(f"({k}, '{a}', {p})" for k, (a, p) in enumerate(SITES))}), {TITLE_SQL},
fields AS (SELECT page_id, 0 AS field, url AS t FROM pages UNION ALL SELECT page_id, 1, title FROM titled),
h AS (SELECT page_id, place, min((field, ordinal, alias)) AS first FROM fields JOIN names ON contains(lower(t), alias) GROUP BY 1, 2)
SELECT page_id, arg_min(place, first) AS place, arg_min(first[3], first) AS alias, string_agg(CAST(place AS VARCHAR), ',' ORDER BY first) AS places FROM h GROUP BY page_id""",
    "dedup_text": f"SELECT min(doc_id) AS doc_id, k AS text_key FROM (SELECT doc_id, {KEY_SQL.format(c='text')} AS k FROM documents WHERE text IS NOT NULL) GROUP BY k",
    "unseen_articles": f"""
WITH k AS (SELECT doc_id, source, {KEY_SQL.format(c='text')} AS text_key FROM documents)
SELECT min(doc_id) AS doc_id, text_key FROM k WHERE source = 'src0' AND text_key NOT IN (SELECT text_key FROM k WHERE source <> 'src0' AND text_key IS NOT NULL) GROUP BY text_key""",
    "semi_by_word": r"""
WITH firsts AS (SELECT DISTINCT lower(string_split(trim(text), ' ')[1]) AS w FROM benchmark), words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents)
SELECT DISTINCT doc_id FROM words JOIN firsts USING (w) WHERE w <> ''""",
    "page_titles": f"""
WITH {TITLE_SQL}
SELECT page_id, title, substr(trim(regexp_replace(regexp_replace(regexp_replace(title, '\\s*\\|.*$', ''), '\\s*-\\s*$', ''), '\\s+', ' ', 'g')), 1, 200) AS headline,
       {KEY_SQL.format(c='title')} AS text_key, lower(substr(regexp_replace(title, '[^a-zA-Z0-9]', '', 'g'), 1, 40)) AS content_key,
       CASE WHEN regexp_matches(title, '[,"\\n]') THEN '"' || replace(title, '"', '""') || '"' ELSE title END AS csv FROM titled""",
    "page_lists": """
SELECT page_id, CAST(len(regexp_extract_all(html, '<li>', 0)) AS BIGINT) AS items, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') AS links FROM pages""",
    "stripped_chars": r"""
SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) AS n,
       length(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS plain FROM pages""",
    "moderated_reports": f"""
WITH m AS (
  SELECT role, CASE WHEN contains(text, '!!') THEN 'rejected' WHEN role <> 'system' AND (role <> 'user' OR length(text) % 100 < 40) THEN 'rejected'
    WHEN role <> 'system' AND length(text) % 100 >= 70 THEN 'approved' WHEN role <> 'system' THEN 'pending' ELSE 'approved' END AS status,
    CASE turn % {len(ISSUE_AGENCIES) + 1} {" ".join(f"WHEN {k} THEN '{a}'" for k, a in enumerate(ISSUE_AGENCIES.values()))} END AS agency FROM conversations)
SELECT role, status, agency, count(*) AS n FROM m GROUP BY ALL""",
    "source_slugs": "SELECT lower(source || '-' || lang) AS slug, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1",
}
