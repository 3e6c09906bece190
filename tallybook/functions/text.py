"""Parsing and cleaning of the text found in public records, as built-in column expressions.

Numbers in text are parsed leniently (a bad number is null or 0 as told, never an error), dates that don't parse are
null, and every function gives null for a null input unless told otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't tell one firm's name from another's (the slash is dropped before they are looked for).
STOP_WORDS = ("MR", "MRS", "SMT", "SRI", "SHRI", "PVT", "LTD", "LIMITED", "PRIVATE", "INDIA", "BANGALORE", "BENGALURU")

#: Publisher names that feeds put behind a headline.
PUBLISHERS = (
    "MSN", "x\\.com", "Deccan Herald", "The Hindu", "Asianet Newsable", "Times of India", "NDTV", "Hindustan Times", "Economic Times",
    "The News Minute", "Citizen Matters", "New Indian Express", "Bangalore Mirror", "India Today",
)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank: one field under several headers."""
    return F.coalesce(*(blank_to_null(c) for c in columns))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A regex group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def rounded(c: Column, places: int) -> Column:
    """A double at so many decimals, as DuckDB's and C's rounding scales it: 1.005 times 100 lies below the half."""
    scale = F.lit(10.0**places)
    return F.round(c * scale) / scale


# Vendors and work orders


def trailing_phone(raw: Column) -> Column:
    """Ten digits at the end of a vendor string."""
    return found(F.trim(raw), r"(\d{10})$")


def vendor_name(raw: Column) -> Column:
    """Vendor string without phone, leading six-digit code, honorific and trailing punctuation."""
    name = F.trim(F.regexp_replace(F.trim(raw), r"\d{10}$", ""))
    name = F.regexp_replace(name, r"^\d{6}\s*", "")
    name = F.trim(F.regexp_replace(name, r"^(M/[Ss]\.?\s*|Sri\.?\s*|Smt\.?\s*)", ""))
    return blank_to_null(F.regexp_replace(name, r"[.,/]+$", ""))


def leading_number(c: Column) -> Column:
    """The number a text starts with: `1,234` is 1, `12abc` is 12, `abc` is null."""
    return found(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))").try_cast("double")


def thousands_number(c: Column) -> Column:
    """A number with thousands commas; null if it isn't one."""
    return F.trim(F.regexp_replace(c, ",", "")).try_cast("double")


def digits_money(c: Column) -> Column:
    """Digits and points only: `Rs 1,200.50` is 1200.5; 0 if nothing is left."""
    return F.coalesce(F.regexp_replace(c, r"[^\d.]", "").try_cast("double"), F.lit(0.0))


def deduction_or_rest(deduction: Column, amount: Column, net: Column) -> Column:
    """The stated deduction, or what is missing from the amount if none is stated."""
    return F.when(F.coalesce(deduction, F.lit(0)) != 0, deduction).otherwise(F.greatest(F.lit(0), amount - net))


def ward_of_order(explicit: Column, order_id: Column, column: Column) -> Column:
    """Ward number as given, else from `WARD-YY-N`, else from the ward column."""
    return F.coalesce(explicit.cast("int"), found(order_id, r"^(\d+)-").try_cast("int"), leading_number(column).cast("int"))


def ward_in_title(title: Column) -> Column:
    return found(title, r"(?i)ward\s*no\.?\s*(\d+)").try_cast("int")


def ward_in_file_name(name: Column) -> Column:
    return found(name, r"(?i)ward[\s_-]*(?:no\.?)?[\s_-]*(\d+)").try_cast("int")


def ward_of_label(label: Column) -> Column:
    """Number in labels like `001 Name` or `o017 Name`."""
    return found(label, r"^o*(\d+)\s").try_cast("int")


def is_current_ward(label: Column, bucket: Column) -> Column:
    """Whether a label is of a ward that counts: not the common bucket (300), and without the leading `o` of wards that are no more."""
    return (bucket.cast("string") != "300") & ~label.rlike(r"(?i)^o+\d")


def fiscal_year_of_code(code: Column) -> Column:
    """`NNN-26-...` is of fiscal year 2025-26."""
    end = found(code, r"^\d+-(\d{2})-").try_cast("int")
    return F.concat(F.lit(2000) + end - 1, F.lit("-"), F.lpad(end.cast("string"), 2, "0"))


def year_in(text: Column) -> Column:
    return found(text, r"(\d{4})").try_cast("int")


def date_d_mon_yyyy(c: Column) -> Column:
    """First `d-MMM-yyyy` anywhere in a text; null for an unknown month."""
    return F.try_to_date(found(c, r"(\d{1,2}-\w{3}-\d{4})"), "d-MMM-yyyy")


def date_dd_mm_yyyy(c: Column) -> Column:
    """Date of `dd-MM-yyyy hh:mm`."""
    return F.try_to_date(found(c, r"(\d{2}-\d{2}-\d{4})"), "dd-MM-yyyy")


def rfc822_timestamp(c: Column) -> Column:
    """`Tue, 03 Jun 2025 10:00:00 +0530` as a timestamp; the weekday is not needed, named zones and none are Greenwich time."""
    moment, zone = found(c, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})"), found(c, r"\d{2}:\d{2}:\d{2}\s+([+-]\d{4})")
    return F.try_to_timestamp(F.concat(moment, F.lit(" "), F.coalesce(zone, F.lit("+0000"))), F.lit("d MMM yyyy HH:mm:ss Z"))


def after_marker(c: Column, marker: str) -> Column:
    """Text behind a marker up to the next `<` or `&`."""
    return blank_to_null(found(c, rf"\Q{marker}\E([^<&]*)"))


def job_fields(c: Column) -> Column:
    """Start and end date, division, budget head and vendor from a portal's job cell."""
    plain = unescaped(c)
    return F.struct(
        date_d_mon_yyyy(after_marker(plain, "Start :")).alias("start_date"),
        date_d_mon_yyyy(after_marker(plain, "End :")).alias("end_date"),
        after_marker(plain, "Division :").alias("division"),
        after_marker(plain, "Budget :").alias("budget_head"),
        after_marker(plain, "Contractor :").alias("contractor_raw"),
    )


def coded_name(c: Column) -> Column:
    """`123456 Name` as struct(code, name)."""
    code = found(c, r"^(\d{3,8})\s+.+$")
    name = F.when(code.isNotNull(), F.trim(found(c, r"^\d{3,8}\s+(.+)$"))).otherwise(F.trim(c))
    return F.struct(code.alias("code"), name.alias("name"))


def labelled_segment(c: Column, label: str) -> Column:
    """Text of the first `<br>`-separated segment that starts with a label, so `BR` is not found in `SBR`."""
    segments = F.transform(F.split(unescaped(c), r"(?i)<br\s*/?>"), lambda s: F.trim(s))
    segment = F.get(F.filter(segments, lambda s: s.startswith(label)), F.lit(0))
    return blank_to_null(F.substr(segment, F.lit(len(label) + 1), F.length(segment)))


def lakh_of_rupees(c: Column) -> Column:
    """Rupees to lakh, half away from minus infinity at two decimals."""
    return F.floor(c / 1000 + 0.5) / 100


# Contacts and names


def phones(c: Column) -> Column:
    """Landline (0xx-...) or ten-digit numbers in a text."""
    return F.regexp_extract_all(c, F.lit(r"(0\d{2,4}-?\d{6,8}|\d{10})"), F.lit(1))


def emails(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"([\w.+-]+@[\w-]+\.[\w.]+)"), F.lit(1)), F.lower)


def without_code_suffix(c: Column) -> Column:
    """`Name (123)` without the code."""
    return F.trim(F.regexp_replace(c, r"\s*\(\d+\)\s*$", ""))


def letter_runs(c: Column, shortest: int, longest: int) -> Column:
    """Distinct runs of so many characters of a text."""

    def of_size(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))

    runs = F.concat(*(of_size(n) for n in range(shortest, longest + 1)))
    return F.array_distinct(F.filter(runs, lambda g: F.length(g) >= shortest))


def entity_key(name: Column) -> Column:
    """Upper case, letters and digits only, no stop words, single blanks; empty for null."""
    plain = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"[^A-Z0-9\s]", "")
    plain = F.regexp_replace(plain, rf"\b({'|'.join(STOP_WORDS)})\b", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def name_tokens(key: Column) -> Column:
    """Distinct tokens of an entity key longer than two characters."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: F.length(t) > 2))


def name_distance(a: Column, b: Column) -> Column:
    """0 for equal entity keys, 0.1 if one contains the other, else 1 less the Jaccard similarity of their tokens."""
    s, t = name_tokens(a), name_tokens(b)
    return (
        F.when((a == "") | (b == ""), 1.0)
        .when(a == b, 0.0)
        .when(F.contains(a, b) | F.contains(b, a), 0.1)
        .when((F.size(s) == 0) | (F.size(t) == 0), 1.0)
        .otherwise(1.0 - F.size(F.array_intersect(s, t)) / F.size(F.array_union(s, t)))
    )


# Markup, headlines, keys


def unescaped(c: Column) -> Column:
    """The entities that feeds and portals use."""
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def without_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def headline(c: Column) -> Column:
    """Without what follows a bar, trailing dashes and extra blanks; 200 characters."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\s*\|.*$", ""), r"\s*-\s*$", "")
    return F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, 200)


def headline_without_publisher(c: Column) -> Column:
    """Without publisher suffix, hashtags, mentions and extra blanks."""
    plain = F.regexp_replace(c, rf"(?i)\s*[-|]\s*({'|'.join(PUBLISHERS)}).*$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\s*[-|]\s*$", ""), r"[#@]\w+", "")
    return F.trim(F.regexp_replace(plain, r"\s{2,}", " "))


def text_key(c: Column, length: int = 60) -> Column:
    """Lower case, letters, digits and single blanks, cut: the key by which repeated headlines are found."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), " +", " ")
    return F.substring(F.trim(plain), 1, length)


def content_key(c: Column, length: int = 40) -> Column:
    return F.lower(F.substring(F.regexp_replace(c, "[^a-zA-Z0-9]", ""), 1, length))


def cache_key(*columns: Column) -> Column:
    """First eight hex digits of the MD5 of the columns as JSON."""
    return F.substring(F.md5(F.to_json(F.struct(*columns))), 1, 8)


def csv_field(c: Column) -> Column:
    """Quoted only where it holds a comma, a quote or a newline; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def shortened(c: Column, length: int, mark: str = "...") -> Column:
    """At most `length` characters, the mark included."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length - len(mark)), F.lit(mark))).otherwise(c)


def representative_label(name: Column, party: Column, cases: Column) -> Column:
    """`Name (Party), n criminal cases`."""
    said = F.when(cases > 0, F.concat(F.lit(", "), cases, F.when(cases == 1, " criminal case").otherwise(" criminal cases"))).otherwise("")
    return F.concat(name, F.when(blank_to_null(party).isNull(), "").otherwise(F.concat(F.lit(" ("), party, F.lit(")"))), said)


# Formats


def fixed_decimals(c: Column, places: int) -> Column:
    """A double with so many decimals, by its binary value as C's printf does: 1.45 lies below the half, true halves go to the even digit."""
    return F.call_function("format_number", c, F.lit("0." + "0" * places))


def money_label(lakh: Column) -> Column:
    """Lakh as `Rs n L`, or `Rs n Cr` from a hundred lakh on."""
    return F.when(lakh >= 100, F.concat(F.lit("Rs "), fixed_decimals(lakh / 100, 2), F.lit(" Cr"))).otherwise(F.concat(F.lit("Rs "), fixed_decimals(lakh, 2), F.lit(" L")))


def short_money(lakh: Column) -> Column:
    """Whole crores from a hundred lakh on, else whole lakh: `Rs 3 Cr`, `Rs 45 L`."""
    value = lakh.cast("double")
    return F.when(value >= 100, F.format_string("Rs %.0f Cr", value / 100)).otherwise(F.format_string("Rs %.0f L", value))


def rupees(amount: Column) -> Column:
    """Rupees with thousands commas and no paise; a dash for null."""
    return F.coalesce(F.format_number(amount, 0), F.lit("-"))


def compact_rupees(amount: Column) -> Column:
    """Rupees as `1.2 Cr` from a crore on, `3.4 L` from a lakh on, else whole thousands: `56K`."""
    value = amount.cast("double")
    return F.when(value >= 1e7, F.concat(fixed_decimals(value / 1e7, 1), F.lit(" Cr"))).when(value >= 1e5, F.concat(fixed_decimals(value / 1e5, 1), F.lit(" L"))).otherwise(F.concat(F.floor(value / 1000 + 0.5).cast("string"), F.lit("K")))


def ward_money(lakh: Column) -> Column:
    """Lakh as `Rs. 56L`, or with one decimal as crores of ten thousand from there on."""
    value = lakh.cast("double")
    return F.when(value >= 10_000, F.concat(F.lit("Rs. "), fixed_decimals(value / 10_000, 1), F.lit(" Cr"))).otherwise(F.format_string("Rs. %.0fL", value))


def title_case(c: Column) -> Column:
    """Each word with a capital."""
    return F.initcap(F.trim(c))


def relative_time(then: Column, as_of: Column) -> Column:
    """`5m ago`, `3h ago`, `2d ago`."""
    minutes = F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))) / 60)
    return F.when(minutes < 60, F.concat(minutes, F.lit("m ago"))).when(minutes < 1440, F.concat(F.floor(minutes / 60), F.lit("h ago"))).otherwise(F.concat(F.floor(minutes / 1440), F.lit("d ago")))


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 for an empty whole."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole + 0.5)).otherwise(0).cast("bigint")
