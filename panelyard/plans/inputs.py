"""How the given tables stand in for incidents, areas and panels, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators.panel import add_conflict_features, build_grid
from panelyard.plans.registry import table

FIRST_MONTH, LAST_MONTH = "1995-01-01", "2001-08-01"


def incidents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as incidents: nation is the area, urgent orders are composite."""
    orders = table(spark, d, "orders").withColumn("start", F.to_date("o_orderdate"))
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("record_id"),
        F.col("c_nationkey").alias("area"),
        "start",
        (F.col("o_orderpriority") == "1-URGENT").alias("composite"),
        F.log1p(F.col("o_totalprice") / 1000).alias("severity"),
        ((F.col("c_acctbal") - 4500) / 5500).alias("tone"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", 0)
        .when(F.col("c_mktsegment") == "BUILDING", 1)
        .when(F.col("c_mktsegment") == "FURNITURE", 2)
        .when(F.col("c_mktsegment") == "HOUSEHOLD", 3)
        .when(F.col("c_mktsegment") == "MACHINERY", 4)
        .alias("topic"),
        "o_totalprice",
        "o_orderstatus",
        "o_orderpriority",
    )


INCIDENTS = """
incidents AS (
  SELECT o_orderkey AS record_id, c_nationkey AS area, CAST(o_orderdate AS DATE) AS start,
         o_orderpriority = '1-URGENT' AS composite, ln(1 + o_totalprice / 1000) AS severity,
         (c_acctbal - 4500) / 5500 AS tone,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
              WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END AS topic,
         o_totalprice, o_orderstatus, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def rare(events: DataFrame) -> DataFrame:
    """The rare incidents that define onset: urgent and expensive."""
    return events.filter(F.col("composite") & (F.col("o_totalprice") > 450_000))


def area_grid(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("county")
    )
    return build_grid(nations, FIRST_MONTH, LAST_MONTH)


GRID = """
grid AS (
  SELECT n_nationkey AS area, n_regionkey AS county, CAST(m AS DATE) AS panel_date,
         year(m) AS "Year", month(m) AS "Month"
  FROM nation, (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH)) AS m))"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Persistence over all incidents; onset over the rare ones."""
    events = incidents(spark, d)
    return add_conflict_features(
        area_grid(spark, d), events, "area", "start", "severity", "composite", onset_events=rare(events)
    )


def decayed_sql(days: str = "180", group: str = "area", measures: str = "") -> str:
    """Decayed sums by the defining range join."""
    return f"""
decayed AS (
  SELECT g.{group}, g.panel_date,
         sum(exp(-ln(2) * date_diff('day', e.start, g.panel_date)
             / CASE WHEN e.composite THEN {days} * 3.0 ELSE {days} END)) AS conflict_persistence,
         sum(exp(-ln(2) * date_diff('day', e.start, g.panel_date)
             / CASE WHEN e.composite THEN {days} * 3.0 ELSE {days} END) * coalesce(e.severity, 0))
             AS conflict_severity_weighted{measures}
  FROM grid g JOIN incidents e ON e.{group} = g.{group} AND e.start <= g.panel_date
  GROUP BY g.{group}, g.panel_date)"""


PANEL = f"""{INCIDENTS}, {GRID}, {decayed_sql()},
onsets AS (
  SELECT DISTINCT area, CAST(date_trunc('month', start) AS DATE) AS panel_date
  FROM incidents WHERE composite AND o_totalprice > 450000),
panel AS (
  SELECT g.*, coalesce(p.conflict_persistence, 0) AS conflict_persistence,
         coalesce(p.conflict_severity_weighted, 0) AS conflict_severity_weighted,
         o.area IS NOT NULL AS conflict_onset
  FROM grid g LEFT JOIN decayed p ON p.area = g.area AND p.panel_date = g.panel_date
  LEFT JOIN onsets o ON o.area = g.area AND o.panel_date = g.panel_date)"""


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)
