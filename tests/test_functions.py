"""Scalar functions on small hand-written cases."""

import datetime as dt

from pyspark.sql import functions as F

from tallybook.functions import bands, text
from tallybook.operators.scoring import accountability_score


def one(spark, expression, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(expression.alias("x")).first()["x"]


def test_vendor_strings(spark):
    raw = F.col("raw")
    for given, name, phone in [
        ("123456 M/s Alpha Works0000000001", "Alpha Works", "0000000001"), ("Sri. Beta.,", "Beta", None), (".,/", None, None), ("Smt Gamma", "Gamma", None),
    ]:
        assert one(spark, text.vendor_name(raw), raw=given) == name
        assert one(spark, text.trailing_phone(raw), raw=given) == phone


def test_numbers_and_dates(spark):
    x = F.col("x")
    assert [one(spark, text.leading_number(x), x=v) for v in ("1,234", "12abc", "abc", " -3.5 ")] == [1.0, 12.0, None, -3.5]
    assert one(spark, text.thousands_number(x), x="1,234.5") == 1234.5
    assert [one(spark, text.digits_money(x), x=v) for v in ("Rs 1,200.50", "none")] == [1200.5, 0.0]
    assert one(spark, text.date_d_mon_yyyy(x), x="on 5-Mar-2024 it") == dt.date(2024, 3, 5)
    assert one(spark, text.date_d_mon_yyyy(x), x="5-Xyz-2024") is None
    assert one(spark, text.date_dd_mm_yyyy(x), x="07-08-2025 10:00") == dt.date(2025, 8, 7)
    assert one(spark, text.rfc822_timestamp(x).cast("string"), x="Tue, 03 Jun 2025 10:00:00 GMT") == "2025-06-03 10:00:00"
    assert [one(spark, text.fiscal_year_of_code(x), x=v) for v in ("001-26-000006", "x")] == ["2025-26", None]
    assert one(spark, text.lakh_of_rupees(x), x=1234567.0) == 12.35


def test_wards(spark):
    x = F.col("x")
    assert [one(spark, text.ward_in_title(x), x=v) for v in ("Drain in Ward No. 12", "ward 7", "none")] == [12, None, None]
    assert [one(spark, text.ward_of_label(x), x=v) for v in ("001 Foo", "o017 Foo", "oo194 Foo", "Foo")] == [1, 17, 194, None]
    assert one(spark, text.ward_of_order(F.lit(None), F.lit("045-24-1"), F.lit("9"))) == 45


def test_portal_cells(spark):
    x = F.col("x")
    cell = "Start :1-Jan-2024<br>Division :North&nbsp;A<br>Budget :P1<br>Contractor :000123 Delta"
    fields = one(spark, text.job_fields(x), x=cell)
    assert (fields["start_date"], fields["end_date"], fields["division"], fields["contractor_raw"]) == (dt.date(2024, 1, 1), None, "North A", "000123 Delta")
    blob = "Order : A<br/>SBR : B<br/>BR : C<br/><br/>Payment : Paid"
    assert [one(spark, text.labelled_segment(x, f"{k} :"), x=blob) for k in ("Order", "SBR", "BR", "Payment", "None")] == ["A", "B", "C", "Paid", None]
    assert tuple(one(spark, text.coded_name(x), x="000123 Delta Co")) == ("000123", "Delta Co")


def test_names(spark):
    key = lambda s: text.entity_key(F.lit(s))
    distance = lambda a, b: one(spark, text.name_distance(key(a), key(b)))
    assert one(spark, key("M/s. Alpha Works Pvt. Ltd.")) == "MS ALPHA WORKS"
    assert distance("Alpha Works Ltd", "alpha works") == 0
    assert distance("Alpha", "Alpha Works") == 0.1
    assert distance("one two three four", "one two three five") == 0.4
    assert distance("one two three", "one two four") == 0.5
    assert distance("Pvt Ltd", "Alpha") == 1


def test_text_keys(spark):
    x = F.col("x")
    assert one(spark, text.slug(x), x="  A b--C! ") == "a-b-c"
    assert one(spark, text.headline(x), x="Lake  dries | Paper") == "Lake dries"
    assert one(spark, text.headline_without_publisher(x), x="Lake dries #lake @me - The Hindu today") == "Lake dries"
    assert one(spark, text.text_key(x), x="Lake: dries,  AGAIN!") == "lake dries again"
    assert [one(spark, text.csv_field(x), x=v) for v in ('a,"b"', "plain")] == ['"a,""b"""', "plain"]
    assert one(spark, text.emails(x), x="Mail A.B@x.org") == ["a.b@x.org"]


def test_decimals_by_binary_value(spark):
    x = F.col("x")
    # 14500 is a true 1.45 on paper, but lies below it as a double; 12500 is a true half.
    assert [one(spark, text.ward_money(x), x=v) for v in (12500, 14500, 37500, 10500, 9999)] == ["Rs. 1.2 Cr", "Rs. 1.4 Cr", "Rs. 3.8 Cr", "Rs. 1.1 Cr", "Rs. 9999L"]
    assert [one(spark, text.compact_rupees(x), x=v) for v in (12_500_000, 145_000, 99_500)] == ["1.2 Cr", "1.4 L", "100K"]
    assert [one(spark, text.money_label(x), x=v) for v in (1.005, 100.5, 0.0)] == ["Rs 1.00 L", "Rs 1.00 Cr", "Rs 0.00 L"]
    assert [one(spark, text.fixed_decimals(x, 1), x=v) for v in (-0.01, 0.25, 0.35, 1234567.85)] == ["-0.0", "0.2", "0.3", "1234567.9"]


def test_rounding_scales_first(spark):
    x = F.col("x")
    assert [one(spark, text.rounded(x, 2), x=v) for v in (1.005, 4648.775, 2.345, 0.125, -0.125, 7.0)] == [1.0, 4648.77, 2.35, 0.13, -0.13, 7.0]


def test_scores_and_bands(spark):
    score = lambda *v: one(spark, accountability_score(*(F.lit(x).cast("double") for x in v)))
    assert score(80, 60, 0, 0, 0) == 78
    assert score(80, None, None, 0, 0) is None
    assert score(120, 100, 5, 0, 0) == round(400 / 5.5)
    assert score(100, None, None, 3, 4) == 57
    assert [one(spark, bands.score_band(F.lit(v))) for v in (70, 50, 30, 29)] == ["green", "yellow", "orange", "red"]
    assert [one(spark, bands.committee_band(F.lit(v))) for v in (0, 9, 24, 25)] == ["never met", "rarely", "sometimes", "regularly"]
