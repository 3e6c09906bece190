"""The city's SQL surface: table functions with defaults, and SQL text with named parameters over registered views.

The functions are SQL themselves, so Catalyst plans a call as if its body stood there: filters, joins and laterals reach into it.
They read the views analytics_events (event, ward_name, created_at), community_activity (kind, ward_no, created_at, id), wards
(ward_no, ward_name, assembly_constituency) and ward_stats (see STATS). Moments are parameters, never the clock.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that recent_activity can give at most; fewer can be asked for.
MOST = 100

#: Columns of ward_stats that are summed to `total_...` of a constituency.
TOTALS = (
    "population", "area_sqkm", "households", "road_length_km", "lakes", "parks", "playgrounds", "govt_schools", "police_stations", "fire_stations", "bus_stops", "bus_routes", "streetlights",
)
#: Columns that are summed under their own name (streetlights in working order under `working_streetlights`).
SUMS = {"working_streetlights": "streetlights", "trees": "trees", "namma_clinics": "namma_clinics", "dwcc_count": "dwcc_count"}
STATS = ("ward_no", "assembly_constituency", *TOTALS, *SUMS, "data_year", "source")


def _functions(temporary: str) -> list[str]:
    totals = ", ".join([f"sum({c}) AS total_{c}" for c in TOTALS] + [f"sum({c}) AS {name}" for c, name in SUMS.items()])
    kinds = ", ".join([f"total_{c} DOUBLE" for c in TOTALS] + [f"{name} DOUBLE" for name in SUMS.values()])
    return [
        f"""CREATE OR REPLACE {temporary} FUNCTION top_event_wards(p_event STRING, p_as_of TIMESTAMP_NTZ, p_days INT DEFAULT 7) RETURNS TABLE (ward_name STRING, count BIGINT)
RETURN SELECT ward_name, count(*) AS count FROM analytics_events
WHERE event = p_event AND ward_name IS NOT NULL AND created_at >= p_as_of - make_dt_interval(p_days) AND created_at <= p_as_of
GROUP BY ward_name ORDER BY count DESC, ward_name LIMIT 10""",
        f"""CREATE OR REPLACE {temporary} FUNCTION recent_activity(p_as_of TIMESTAMP_NTZ, p_limit INT DEFAULT 15) RETURNS TABLE (place INT, kind STRING, id BIGINT, ward_no INT, ward_name STRING, created_at TIMESTAMP_NTZ)
RETURN SELECT place, kind, id, newest.ward_no, ward_name, created_at FROM (
  SELECT row_number() OVER (ORDER BY created_at DESC, id) AS place, * FROM (SELECT * FROM community_activity WHERE created_at <= p_as_of ORDER BY created_at DESC, id LIMIT {MOST})) newest
LEFT JOIN wards ON newest.ward_no = wards.ward_no WHERE place <= p_limit""",
        f"""CREATE OR REPLACE {temporary} FUNCTION ward_stats_by_ac(p_ac STRING DEFAULT NULL) RETURNS TABLE (assembly_constituency STRING, {kinds}, avg_population_density DOUBLE, ward_count BIGINT, data_year INT, source STRING)
RETURN SELECT assembly_constituency, {totals}, round(avg(population / nullif(area_sqkm, 0)), 2) AS avg_population_density, count(*) AS ward_count, max(data_year) AS data_year,
  array_join(array_sort(collect_set(source)), ', ') AS source FROM ward_stats WHERE p_ac IS NULL OR assembly_constituency = p_ac GROUP BY assembly_constituency""",
    ]


def create_functions(spark: SparkSession, temporary: bool = True) -> None:
    """Create the table functions over the views that are registered, for the session or for its catalogue."""
    for text in _functions("TEMPORARY" if temporary else ""):
        spark.sql(text)


def register(views: dict[str, DataFrame]) -> None:
    """Give DataFrames their names in SQL text."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def query(spark: SparkSession, text: str, **parameters: object) -> DataFrame:
    """SQL text with `:name` parameters; they are values, never text that is pasted in."""
    return spark.sql(text, args=parameters)


def call(spark: SparkSession, function: str, **parameters: object) -> DataFrame | None:
    """A table function's result with parameters by name; None where there is no such function, view or parameter."""
    if not function.isidentifier() or not all(name.isidentifier() for name in parameters):
        raise ValueError("names of functions and parameters are identifiers")
    try:
        return spark.sql(f"SELECT * FROM {function}({', '.join(f'{name} => :{name}' for name in parameters)})", args=parameters)
    except AnalysisException:
        return None


def grouped_remote(df: DataFrame, by: str, n: str = "n") -> DataFrame:
    """Counts by one column as a map service's statistics give them: groups without a value or of nothing are dropped."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias(n)).where(F.col(n) > 0)
