"""HTML tables and news feeds, by regular expressions in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import blank_to_null, found, rfc822_timestamp, unescaped, without_tags
from tallybook.session import written


def tag_texts(html: Column, tag: str) -> Column:
    """Texts of all elements of a tag, in order, without inner markup."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)), lambda x: unescaped(without_tags(x)))


def table_rows(pages: DataFrame, html: str, least_cells: int = 5) -> DataFrame:
    """Rows of HTML tables as arrays of cell texts: at least so many cells, the first an integer."""
    rows = pages.select("*", F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>"), F.lit(1))).alias("_tr"))
    return rows.withColumn("cells", tag_texts(F.col("_tr"), "td")).drop("_tr").where((F.size("cells") >= least_cells) & F.get("cells", F.lit(0)).rlike(r"^\d+$"))


def listed_names(pages: DataFrame, html: str, cell: int, source: str, noise: tuple[str, ...] = ("Sl", "Period")) -> DataFrame:
    """Names from one column of debarment tables, without headings, numbers, mail addresses and scraps."""
    rows = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>"), F.lit(1))).alias("tr"))
    named = rows.select(F.get(tag_texts(F.col("tr"), "td"), F.lit(cell)).alias("listed_name"), F.lit(source).alias("source"))
    name = F.col("listed_name")
    keep = (F.length(name) > 3) & ~name.rlike(r"^\d") & ~F.contains(name, F.lit("@"))
    for word in noise:
        keep = keep & ~name.startswith(word)
    return named.where(keep).distinct()


def feed_items(feeds: DataFrame, xml: str, least_title: int = 10, first: int | None = None) -> DataFrame:
    """Items of RSS and entries of Atom feeds by a scan: title, body, link, published, place; short titles are dropped, `first` items of each feed count."""
    items = F.regexp_extract_all(xml, F.lit(r"(?s)<item(?:\s[^>]*)?>(.*?)</item>"), F.lit(1))
    entries = F.regexp_extract_all(xml, F.lit(r"(?s)<entry(?:\s[^>]*)?>(.*?)</entry>"), F.lit(1))
    listed = F.when(F.size(items) > 0, items).otherwise(entries)
    each = feeds.select("*", F.posexplode(F.slice(listed, 1, first) if first else listed).alias("place", "_item"))

    def inner(tag: str) -> Column:
        raw = found(F.col("_item"), rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>")
        return blank_to_null(without_tags(unescaped(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))))

    published = F.coalesce(rfc822_timestamp(inner("pubDate")), F.try_to_timestamp(F.coalesce(inner("published"), inner("updated"))))
    parsed = each.withColumns({"title": inner("title"), "body": F.coalesce(inner("description"), inner("summary")), "link": F.coalesce(inner("link"), found(F.col("_item"), r'<link[^>]*href="([^"]+)"')), "published": published})
    return parsed.drop("_item").where(F.length("title") > least_title)


#: What is read of a feed: RSS 2.0 has its items in the channel, RSS 1.0 beside it, Atom has entries.
_ITEM = "struct<title: string, description: string, link: string, pubDate: string>"
_LINK = "struct<_href: string, _rel: string>"
_ENTRY = f"struct<title: string, summary: string, link: array<{_LINK}>, published: string, updated: string>"
FEED = f"channel struct<item: array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ENTRY}>, _corrupt_record string"


def feed_entries(feeds: DataFrame, xml: str, first: int | None = 15, least_title: int = 10) -> DataFrame:
    """The first items of each RSS or Atom feed, read as XML: the feed's other columns, title, body, link, published, place (from 0), whole.

    Attributes, namespaces, CDATA and entities are the parser's; inner markup is taken out of titles and bodies. Feeds that aren't well-formed
    (`whole` is false) are scanned item by item, so that one broken item doesn't cost the others. Short titles are
    dropped after the first items have been counted.
    """
    cleaned = F.regexp_replace(F.trim(F.regexp_replace(F.col(xml), r"^\uFEFF|<!DOCTYPE[^>]*>", "")), r"^<\?xml[^>]*\?>", "")
    parsed = feeds.withColumn("_feed", F.from_xml(cleaned, FEED, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}))
    kept = [c for c in feeds.columns if c != xml]
    good = F.col("_feed").isNotNull() & F.col("_feed._corrupt_record").isNull()
    told = lambda c: blank_to_null(without_tags(unescaped(c)))
    items = F.transform(F.coalesce("_feed.channel.item", "_feed.item"), lambda i: F.struct(i["title"].alias("title"), i["description"].alias("body"), i["link"].alias("link"), i["pubDate"].alias("rfc"), F.lit(None).cast("string").alias("iso")))
    href = lambda e: F.coalesce(F.get(F.filter(e["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"], F.get(e["link"], F.lit(0))["_href"])
    entries = F.transform("_feed.entry", lambda e: F.struct(e["title"].alias("title"), e["summary"].alias("body"), href(e).alias("link"), F.lit(None).cast("string").alias("rfc"), F.coalesce(e["published"], e["updated"]).alias("iso")))
    listed = F.coalesce(F.when(F.size(items) > 0, items), entries)
    chosen = F.slice(listed, 1, first) if first else listed
    # Written, since a filter on what is parsed would parse each feed again for every mention of it.
    once = written(parsed.select(*kept, F.when(~good, F.col(xml)).alias(xml), F.when(good, chosen).alias("_chosen")))
    each = once.select(*kept, F.posexplode("_chosen").alias("place", "_i"))
    published = F.coalesce(rfc822_timestamp(F.trim("_i.rfc")), F.try_to_timestamp(F.trim("_i.iso")))
    whole = each.select(*kept, told(F.col("_i.title")).alias("title"), told(F.col("_i.body")).alias("body"), blank_to_null(F.col("_i.link")).alias("link"), published.alias("published"), "place", F.lit(True).alias("whole"))
    broken = once.where(F.col(xml).isNotNull()).select(*feeds.columns)
    scanned = feed_items(broken, F.col(xml), -1, first).withColumns({"title": told(F.col("title")), "body": told(F.col("body"))}).select(*whole.columns[:-1], F.lit(False).alias("whole"))
    return whole.unionByName(scanned).where(F.length("title") > least_title)


def links(html: Column) -> Column:
    """href of all anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
