"""Verdict bands of scores and indicators; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(c: Column, limits: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first limit, from the highest down, that the value reaches; `otherwise` below all."""
    labelled = F.when(c.isNull(), F.lit(None).cast("string"))
    for limit, label in sorted(limits, reverse=True):
        labelled = labelled.when(c >= limit, label)
    return labelled.otherwise(otherwise)


def rising_band(c: Column, limits: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first limit, from the lowest up, that the value stays below (or at)."""
    labelled = F.when(c.isNull(), F.lit(None).cast("string"))
    for limit, label in sorted(limits):
        labelled = labelled.when(c <= limit, label)
    return labelled.otherwise(otherwise)


def score_band(score: Column) -> Column:
    return band(score, [(70, "green"), (50, "yellow"), (30, "orange")], "red")


def attendance_band(pct: Column) -> Column:
    return band(pct, [(85, "good"), (75, "fair")], "poor")


def fund_use_band(pct: Column) -> Column:
    return band(pct, [(75, "good"), (50, "fair")], "poor")


def committee_band(meetings: Column) -> Column:
    return F.when(meetings.isNull(), F.lit(None).cast("string")).when(meetings == 0, "never met").when(meetings < 10, "rarely").when(meetings < 25, "sometimes").otherwise("regularly")


def close_rate_band(pct: Column) -> Column:
    return band(pct, [(90, "good"), (70, "fair")], "poor")


def deduction_band(pct: Column) -> Column:
    return F.when(pct.isNull(), F.lit(None).cast("string")).when(pct > 15, "high").when(pct > 10, "raised").otherwise("normal")


def in_time_band(pct: Column) -> Column:
    return band(pct, [(90, "good"), (75, "fair")], "poor")


def questions_band(asked: Column) -> Column:
    return F.when(asked == 0, "poor").when(asked < 10, "fair").when(asked.isNotNull(), "good")


def growth_band(pct: Column) -> Column:
    return F.when(pct > 100, "steep").when(pct.isNotNull(), "normal")


def pm25_band(c: Column) -> Column:
    return rising_band(c, [(35, "good"), (60, "moderate")], "poor")


def pm10_band(c: Column) -> Column:
    return rising_band(c, [(60, "good"), (100, "moderate")], "poor")


def oxygen_band(c: Column) -> Column:
    return band(c, [(6, "good"), (4, "moderate")], "poor")


def oxygen_demand_band(c: Column) -> Column:
    return rising_band(c, [(3, "good"), (6, "moderate")], "poor")


def coliform_band(c: Column) -> Column:
    return rising_band(c, [(500, "good"), (5000, "moderate")], "poor")


def water_class_band(c: Column) -> Column:
    return F.when(c.isin("A", "B"), "good").when(c == "C", "moderate").when(c.isNotNull(), "poor")


def trust_level(corroborations: Column) -> Column:
    return F.when(corroborations >= 5, "community_verified").otherwise("unverified")


def severity(category: Column, red: list[str]) -> Column:
    return F.when(category.isin(*red), "red").when(category.isNotNull(), "yellow")
