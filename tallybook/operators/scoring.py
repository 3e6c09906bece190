"""Accountability scores, headlines and share texts of a ward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accountability_score(attendance: Column, fund_use: Column, cases: Column, flagged: Column, vendors: Column) -> Column:
    """Weighted mean of the dimensions at hand, rounded half up; null with fewer than two.

    Attendance and fund use are capped at 100 and weigh 2, cases cost 20 and flagged vendors 40 points each and weigh
    1.5; flags count only where the ward has vendors.
    """
    dimensions = [
        (F.least(attendance, F.lit(100.0)), 2.0),
        (F.least(fund_use, F.lit(100.0)), 2.0),
        (F.when(cases.isNotNull(), F.greatest(F.lit(0.0), 100.0 - 20 * cases)), 1.5),
        (F.when(vendors > 0, F.greatest(F.lit(0.0), 100.0 - 40 * flagged)), 1.5),
    ]
    values = [F.when(v.isNotNull(), v) for v, _ in dimensions]
    # least() skips nulls, so a missing input has to be told apart first.
    inputs = [attendance, fund_use, cases, F.when(vendors > 0, vendors)]
    present = [F.when(x.isNotNull(), 1).otherwise(0) for x in inputs]
    total = sum((F.when(x.isNotNull(), v * w).otherwise(0.0) for x, v, (_, w) in zip(inputs, values, dimensions)), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, (_, w) in zip(inputs, dimensions)), F.lit(0.0))
    return F.when(sum(present, F.lit(0)) >= 2, F.floor(total / weight + 0.5).cast("int"))


# What a headline says, `{}` being its figure.
HEADLINES = {
    "flagged_one": "{} flagged contractor active in this ward",
    "flagged": "{} flagged contractors active in this ward",
    "case": "MLA has {} criminal case",
    "cases": "MLA has {} criminal cases",
    "fund_unused": "MLA has spent 0% of development funds",
    "attendance": "MLA attended only {}% of assembly sessions",
    "no_meetings": "Ward committee has never met",
    "no_signals": "This ward has zero traffic signals",
    "fund_low": "Only {}% of MLA development funds used",
}


def pick_headline(candidates: list[tuple[int, Column, str, Column]]) -> Column:
    """struct(priority, severity, text) of the candidate (priority, condition, severity, text) with the highest priority that holds."""
    options = F.array(*(F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(p).alias("priority"), F.lit(s).alias("severity"), text.alias("text"))) for p, holds, s, text in candidates))
    return F.array_max(F.filter(options, lambda x: x.isNotNull()))


def ward_headline(flagged: Column, cases: Column, fund_use: Column, attendance: Column, meetings: Column, signals: Column) -> Column:
    """The most alarming thing to say about a ward, or null."""
    say = lambda name, figure=None: F.lit(HEADLINES[name]) if figure is None else F.replace(F.lit(HEADLINES[name]), F.lit("{}"), F.format_string("%s", figure))
    return pick_headline([
        (100, flagged > 0, "red", F.when(flagged == 1, say("flagged_one", flagged)).otherwise(say("flagged", flagged))),
        (90, cases > 0, "red", F.when(cases == 1, say("case", cases)).otherwise(say("cases", cases))),
        (85, fund_use == 0, "red", say("fund_unused")),
        (80, attendance < 40, "red", say("attendance", attendance)),
        (75, meetings == 0, "red", say("no_meetings")),
        (60, signals == 0, "yellow", say("no_signals")),
        (55, (fund_use > 0) & (fund_use < 30), "yellow", say("fund_low", fund_use)),
    ])


def share_stat(fund_use: Column, cases: Column, attendance: Column, low_attendance: int = 65) -> Column:
    """Which figure a share card shows: the first rule that holds."""
    return (
        F.when(fund_use == 0, "fund_use_zero").when(cases >= 3, "criminal_cases").when(attendance < low_attendance, "attendance").when(fund_use.isNotNull(), "fund_use")
    )


def share_text(ward: Column, name: Column, fund_use: Column, cases: Column, attendance: Column) -> Column:
    """The sentence shared with a ward's link."""
    return (
        F.when(fund_use == 0, F.concat(F.lit("My MLA in "), ward, F.lit(" has spent 0% of the development fund")))
        .when(cases >= 3, F.concat(F.lit("My MLA in "), ward, F.lit(" has "), cases.cast("string"), F.lit(" criminal cases")))
        .when(attendance < 60, F.concat(F.lit("My MLA in "), ward, F.lit(" attended "), attendance.cast("string"), F.lit("% of sessions")))
        .when(name.isNotNull(), F.concat(name, F.lit(" represents "), ward))
        .otherwise(F.concat(F.lit("See who is accountable in "), ward))
    )
