"""Panel construction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators import panel as P
from panelyard.plans.inputs import (
    FIRST_MONTH, GRID, INCIDENTS, LAST_MONTH, PANEL, area_grid, decayed_sql, incidents, panel, r6, rare,
)
from panelyard.plans.registry import query, table


@query(
    "panel_grid",
    f"""WITH {INCIDENTS}, {GRID}
    SELECT g.area, g.county, g.panel_date, g."Year", g."Month", count(e.record_id) AS n_events
    FROM grid g LEFT JOIN incidents e ON e.area = g.area AND date_trunc('month', e.start) = g.panel_date
    GROUP BY ALL""",
)
def panel_grid(spark, d):
    per_month = incidents(spark, d).groupBy("area", F.trunc("start", "month").alias("panel_date")).agg(
        F.count(F.lit(1)).alias("n_events")
    )
    return area_grid(spark, d).join(per_month, ["area", "panel_date"], "left").fillna({"n_events": 0})


@query(
    "decayed_persistence",
    f"""WITH {PANEL}
    SELECT area, panel_date, round(conflict_persistence, 6) AS conflict_persistence FROM panel""",
)
def decayed_persistence(spark, d):
    return panel(spark, d).select("area", "panel_date", r6("conflict_persistence"))


@query(
    "severity_weighted_persistence",
    f"""WITH {PANEL}
    SELECT area, panel_date, round(conflict_severity_weighted, 6) AS conflict_severity_weighted FROM panel""",
)
def severity_weighted_persistence(spark, d):
    return panel(spark, d).select("area", "panel_date", r6("conflict_severity_weighted"))


@query(
    "onset_flag",
    f"""WITH {PANEL} SELECT area, panel_date, conflict_onset FROM panel""",
)
def onset_flag(spark, d):
    return P.add_onset(area_grid(spark, d), rare(incidents(spark, d)), "area", "start").select(
        "area", "panel_date", "conflict_onset"
    )


def _sensitivity_sql():
    runs = []
    for days in (90, 180, 365):
        runs.append(
            f"""SELECT g.county, g.panel_date, {days} AS half_life_days,
              round(coalesce(sum(exp(-ln(2) * date_diff('day', e.start, g.panel_date)
                / CASE WHEN e.composite THEN {days} * 3.0 ELSE {days} END) * e.severity), 0), 6) AS persistence
            FROM months g LEFT JOIN by_county e ON e.county = g.county AND e.start <= g.panel_date
            GROUP BY g.county, g.panel_date"""
        )
    return f"""WITH {INCIDENTS}, {GRID}, months AS (SELECT DISTINCT county, panel_date FROM grid),
    by_county AS (SELECT n_regionkey AS county, i.* FROM incidents i JOIN nation ON area = n_nationkey)
    {" UNION ALL ".join(runs)}"""


@query("half_life_sensitivity", _sensitivity_sql())
def half_life_sensitivity(spark, d):
    areas = table(spark, d, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("county"))
    events = incidents(spark, d).join(areas, "area")
    months = P.build_grid(areas.select("county"), FIRST_MONTH, LAST_MONTH).select("county", "panel_date")
    runs = P.half_life_sensitivity(months, events, "county", "start", "composite", F.col("severity"))
    return runs.select("county", "panel_date", "half_life_days", r6("persistence"))


TEXT_PANEL = f"""{INCIDENTS}, {GRID},
past AS (
  SELECT g.area, g.panel_date, e.topic, coalesce(e.tone, 0) AS tone,
         exp(-ln(2) * date_diff('day', e.start, g.panel_date)
             / CASE WHEN e.composite THEN 540.0 ELSE 180.0 END) AS w
  FROM grid g JOIN incidents e ON e.area = g.area AND e.start <= g.panel_date),
by_topic AS (SELECT area, panel_date, coalesce(topic, -1) AS topic, sum(w) AS w FROM past GROUP BY ALL),
shares AS (SELECT *, w / sum(w) OVER (PARTITION BY area, panel_date) AS p,
             row_number() OVER (PARTITION BY area, panel_date ORDER BY w DESC, topic) AS rk FROM by_topic)"""


def text_panel(spark, d):
    return P.add_text_features(
        area_grid(spark, d), incidents(spark, d), "area", "start", "composite", "tone", "topic"
    )


@query(
    "decayed_sentiment",
    f"""WITH {TEXT_PANEL}, told AS (
      SELECT area, panel_date, sum(w * tone) / sum(w) AS s FROM past GROUP BY ALL)
    SELECT g.area, g.panel_date, round(t.s, 6) AS decayed_sentiment
    FROM grid g LEFT JOIN told t ON t.area = g.area AND t.panel_date = g.panel_date""",
)
def decayed_sentiment(spark, d):
    return text_panel(spark, d).select("area", "panel_date", r6("decayed_sentiment"))


@query(
    "dominant_topic",
    f"""WITH {TEXT_PANEL}
    SELECT g.area, g.panel_date, s.topic AS dominant_topic_id
    FROM grid g LEFT JOIN shares s ON s.area = g.area AND s.panel_date = g.panel_date AND s.rk = 1""",
)
def dominant_topic(spark, d):
    return text_panel(spark, d).select("area", "panel_date", "dominant_topic_id")


@query(
    "topic_diversity",
    f"""WITH {TEXT_PANEL}, mixed AS (
      SELECT area, panel_date, greatest(0, -sum(p * ln(p + 1e-12))) AS h FROM shares GROUP BY ALL)
    SELECT g.area, g.panel_date, round(m.h, 6) AS topic_diversity
    FROM grid g LEFT JOIN mixed m ON m.area = g.area AND m.panel_date = g.panel_date""",
)
def topic_diversity(spark, d):
    return text_panel(spark, d).select("area", "panel_date", r6("topic_diversity"))


@query(
    "static_features",
    f"""WITH {GRID},
    sums AS (SELECT s_nationkey AS area, sum(s_acctbal) AS total_abstraction_m3_per_day, count(*) AS wrua_count
             FROM supplier WHERE s_nationkey IS NOT NULL GROUP BY 1),
    pop AS (SELECT c_nationkey AS area, arg_min(c_acctbal, c_custkey) AS first_balance FROM customer GROUP BY 1)
    SELECT g.area, g.panel_date, round(coalesce(s.total_abstraction_m3_per_day, 0), 4) AS total_abstraction_m3_per_day,
           coalesce(s.wrua_count, 0) AS wrua_count, p.first_balance
    FROM grid g LEFT JOIN sums s USING (area) LEFT JOIN pop p USING (area)""",
)
def static_features(spark, d):
    suppliers = table(spark, d, "supplier")
    customers = table(spark, d, "customer").withColumnsRenamed({"c_nationkey": "area", "c_acctbal": "first_balance"})
    grid = area_grid(spark, d)
    grid = P.add_static_first(grid, customers, "area", "c_custkey", ["first_balance"])
    grid = P.add_static_sum(grid, suppliers, "area", "s_nationkey", "s_acctbal", "total_abstraction_m3_per_day")
    grid = P.add_static_count(grid, suppliers, "area", "s_nationkey", "wrua_count")
    return grid.select(
        "area", "panel_date", F.round("total_abstraction_m3_per_day", 4).alias("total_abstraction_m3_per_day"),
        "wrua_count", "first_balance",
    )


@query(
    "timevarying_features",
    f"""WITH {GRID}, means AS (
      SELECT s_nationkey AS area, year(l_shipdate) AS y, month(l_shipdate) AS m,
             avg(l_quantity) AS "Mean_NDVI", avg(l_discount) AS "Rainfall_mm"
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
    SELECT g.area, g.panel_date, round("Mean_NDVI", 6) AS "Mean_NDVI", round("Rainfall_mm", 6) AS "Rainfall_mm"
    FROM grid g LEFT JOIN means t ON t.area = g.area AND t.y = g."Year" AND t.m = g."Month" """,
)
def timevarying_features(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_discount")
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    rows = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
    full = P.add_monthly_means(
        area_grid(spark, d), rows, "area", "s_nationkey", F.year("l_shipdate"), F.month("l_shipdate"),
        {"Mean_NDVI": F.col("l_quantity"), "Rainfall_mm": F.col("l_discount")},
    )
    return full.select("area", "panel_date", r6("Mean_NDVI"), r6("Rainfall_mm"))


@query(
    "completeness",
    f"""WITH {TEXT_PANEL}, told AS (
      SELECT area, panel_date, sum(w * tone) / sum(w) AS s FROM past GROUP BY ALL),
    full_panel AS (SELECT g.*, t.s FROM grid g LEFT JOIN told t ON t.area = g.area AND t.panel_date = g.panel_date)
    SELECT 'area' AS column_name, round(100.0 * count(area) / count(*), 6) AS percent_complete FROM full_panel
    UNION ALL SELECT 'decayed_sentiment', round(100.0 * count(s) / count(*), 6) FROM full_panel
    UNION ALL SELECT 'dominant_topic_id', round(100.0 * count(s) / count(*), 6) FROM full_panel""",
)
def completeness(spark, d):
    done = P.completeness(text_panel(spark, d), ["area", "decayed_sentiment", "dominant_topic_id"])
    return done.select("column_name", r6("percent_complete"))


@query(
    "peak_area",
    f"""WITH {PANEL}
    SELECT area, round(max(conflict_persistence), 6) AS peak FROM panel GROUP BY area
    ORDER BY max(conflict_persistence) DESC, area LIMIT 1""",
)
def peak_area(spark, d):
    return P.peak_area(panel(spark, d), "area", "conflict_persistence").select("area", r6("peak"))
