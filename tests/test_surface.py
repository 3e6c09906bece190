"""SQL functions by name and parameter, and bounded profiles with empty parts."""

import datetime

import pytest

from tallybook.operators import sql_surface
from tallybook.operators.profile import ward_profiles


@pytest.fixture
def views(spark):
    at = lambda day, hour=0: datetime.datetime(2024, 1, day, hour)
    analytics = spark.createDataFrame([("pin", "A", at(10)), ("pin", "A", at(9)), ("pin", "B", at(9)), ("pin", None, at(9)), ("view", "B", at(9)), ("pin", "C", at(3)), ("pin", "D", at(10, 1))], "event string, ward_name string, created_at timestamp_ntz")
    activity = spark.createDataFrame([("fact", 1, at(2), 5), ("vote", None, at(2), 4), ("vote", 9, at(1), 1), ("vote", 1, at(20), 2)], "kind string, ward_no int, created_at timestamp_ntz, id bigint")
    wards = spark.createDataFrame([(1, "A", "X"), (2, "B", "Y")], "ward_no int, ward_name string, assembly_constituency string")
    figures = [(float(k), *(float(k),) * 12) for k in (1, 2)]
    stats = spark.createDataFrame(
        [(k, "X", *f, 1.0, 2.0, None, 4.0, 2020 + k, f"s{k}") for k, f in enumerate(figures)], "ward_no int, assembly_constituency string, " + ", ".join(f"{c} double" for c in (*sql_surface.TOTALS, *sql_surface.SUMS)) + ", data_year int, source string"
    )
    sql_surface.register({"analytics_events": analytics, "community_activity": activity, "wards": wards, "ward_stats": stats})
    sql_surface.create_functions(spark)


def test_top_wards_with_a_default(spark, views):
    as_of = datetime.datetime(2024, 1, 10)
    text = "SELECT * FROM top_event_wards(:event, CAST(:as_of AS TIMESTAMP_NTZ))"
    assert [tuple(r) for r in sql_surface.query(spark, text, event="pin", as_of=as_of).collect()] == [("A", 2), ("B", 1), ("C", 1)]
    one = sql_surface.query(spark, text.replace("))", "), p_days => 6)"), event="pin", as_of=as_of)
    assert [tuple(r) for r in one.collect()] == [("A", 2), ("B", 1)]
    assert sql_surface.query(spark, text, event="x' OR '1'='1", as_of=as_of).count() == 0


def test_newest_activity_and_stats(spark, views):
    got = sql_surface.query(spark, "SELECT id, ward_name FROM recent_activity(TIMESTAMP_NTZ'2024-01-10 00:00:00', 2) ORDER BY place").collect()
    assert [tuple(r) for r in got] == [(4, None), (5, "A")]
    (row,) = sql_surface.call(spark, "ward_stats_by_ac", p_ac="X").collect()
    assert (row.total_population, row.streetlights, row.namma_clinics, row.avg_population_density, row.ward_count, row.data_year, row.source) == (3.0, 2.0, None, 1.0, 2, 2021, "s0, s1")
    assert len(row) == 22 and sql_surface.call(spark, "ward_stats_by_ac", p_ac="nowhere").count() == 0


def test_what_is_not_there(spark, views):
    assert sql_surface.call(spark, "no_such_function") is None and sql_surface.call(spark, "ward_stats_by_ac", no_such=1) is None
    with pytest.raises(ValueError):
        sql_surface.call(spark, "f(); DROP VIEW wards")


def test_remote_groups(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "kind string")
    assert [tuple(r) for r in sql_surface.grouped_remote(df, "kind").collect()] == [("a", 2)]


def test_a_profile_without_anything(spark):
    wards = spark.createDataFrame([(1, "X"), (2, None)], "ward_no int, assembly_constituency string")
    none = lambda schema: spark.createDataFrame([], schema)
    alerts = spark.createDataFrame([(None, "all", "2024-01-01"), (None, "older", "2023-01-01"), (1, "own", "2022-01-01")], "ward_no int, title string, since string")
    tenders = spark.createDataFrame([(1, k, "t", None if k == 2 else 1.5, f"2024-01-{k:02d}") for k in range(1, 20)], "ward_no int, tender_id int, title string, value_lakh double, issued_date string")
    got = {r.ward_no: r for r in ward_profiles(
        wards, none("assembly_constituency string, role string, name string"), none("ward_no int, role string, name string"), tenders, alerts,
        none("ward_no int, id int, subject string, value string, source_type string, corroboration_count int, dispute_count int, is_active boolean"), most=3,
    ).collect()}
    assert [t.tender_id for t in got[1].tenders] == [19, 18, 17] and (got[1].tender_count, got[1].tender_total_lakh) == (19, 27.0)
    assert (got[2].tenders, got[2].elected_reps, got[2].community_facts, got[2].tender_count, got[2].tender_total_lakh) == ([], [], [], 0, 0.0)
    assert (got[1].governance_alert.title, got[2].governance_alert.title) == ("own", "all")
