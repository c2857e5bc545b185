"""Dashboard-style filters, KPIs and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators import serve as S
from panelyard.plans.inputs import PANEL, panel, r6
from panelyard.plans.registry import query, table


@query(
    "filter_panel",
    f"""WITH {PANEL}
    SELECT area, panel_date, round(conflict_persistence, 6) AS conflict_persistence, conflict_onset FROM panel
    WHERE county = 2 AND "Year" >= 1997 AND "Year" <= 1999""",
)
def filter_panel(spark, d):
    out = S.query_panel(panel(spark, d), 2, None, 1997, 1999, "county", "area")
    return out.select("area", "panel_date", r6("conflict_persistence"), "conflict_onset")


@query(
    "panel_summary",
    f"""WITH {PANEL}
    SELECT count(*) AS total_months, sum(CAST(conflict_onset AS INT))::BIGINT AS total_onset_months,
           round(avg(conflict_persistence), 6) AS avg_persistence,
           round(avg(conflict_severity_weighted), 6) AS avg_severity_weighted
    FROM panel WHERE county = 1""",
)
def panel_summary(spark, d):
    chosen = S.query_panel(panel(spark, d), 1, county_col="county")
    kpis = S.panel_summary(chosen, extra=["conflict_severity_weighted"])
    return kpis.select(
        "total_months", "total_onset_months", r6("avg_persistence"),
        F.round("avg_conflict_severity_weighted", 6).alias("avg_severity_weighted"),
    )


@query(
    "search_records",
    """SELECT doc_id, lang, source FROM documents
    WHERE contains(lower(text), lower('Tion')) AND (lang = 'en' OR contains(lower(source), 'src1'))""",
)
def search_records(spark, d):
    docs = table(spark, d, "documents").filter(S.contains_text(["text"], "Tion"))
    return docs.filter((F.col("lang") == "en") | S.contains_text(["source"], "SRC1")).select("doc_id", "lang", "source")


RAW_INCIDENTS = """
raw AS (
  SELECT o_orderkey AS "Record_ID", 'R' || (o_custkey % 5) AS geo_county, 'S' || (o_custkey % 25) AS geo_subcounty,
         CASE WHEN o_orderkey % 11 = 0 THEN '13/45/' || year(o_orderdate)
              ELSE month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) END AS "Date_Start",
         CAST(o_custkey % 7 AS INT) AS topic_id, o_orderstatus AS conflict_domain,
         o_orderpriority || ' order of ' || o_custkey AS "Incident_Summary",
         CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) END AS "NLP_Keywords"
  FROM orders)"""


def raw_incidents(spark, d):
    """Orders written out as raw incident records with some unreadable dates."""
    o = table(spark, d, "orders")
    date = F.concat_ws("/", F.month("o_orderdate"), F.dayofmonth("o_orderdate"), F.year("o_orderdate"))
    broken = F.concat(F.lit("13/45/"), F.year("o_orderdate").cast("string"))
    return o.select(
        F.col("o_orderkey").alias("Record_ID"),
        F.concat(F.lit("R"), (F.col("o_custkey") % 5).cast("string")).alias("geo_county"),
        F.concat(F.lit("S"), (F.col("o_custkey") % 25).cast("string")).alias("geo_subcounty"),
        F.when(F.col("o_orderkey") % 11 == 0, broken).otherwise(date).alias("Date_Start"),
        (F.col("o_custkey") % 7).cast("int").alias("topic_id"),
        F.col("o_orderstatus").alias("conflict_domain"),
        F.concat(F.col("o_orderpriority"), F.lit(" order of "), F.col("o_custkey").cast("string")).alias("Incident_Summary"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderpriority")).alias("NLP_Keywords"),
    )


@query(
    "filter_incidents",
    f"""WITH {RAW_INCIDENTS}
    SELECT "Record_ID", geo_subcounty, "Date_Start" FROM raw
    WHERE geo_county = 'R2' AND topic_id = 3 AND conflict_domain = 'F'
      AND year(try_strptime("Date_Start", '%m/%d/%Y')) BETWEEN 1996 AND 2000
      AND (contains(CAST("Record_ID" AS VARCHAR), 'high') OR contains(lower("Incident_Summary"), 'high')
           OR coalesce(contains("NLP_Keywords", 'high'), false))""",
)
def filter_incidents(spark, d):
    found = S.query_incidents(
        raw_incidents(spark, d), "R2", None, 1996, 2000, topic_id=3, search="HIGH", domain="F"
    )
    return found.select("Record_ID", "geo_subcounty", "Date_Start")


@query(
    "top_page",
    f"""WITH {RAW_INCIDENTS} SELECT "Record_ID", geo_county, "Date_Start" FROM raw ORDER BY "Record_ID" LIMIT 500""",
)
def top_page(spark, d):
    return S.page(raw_incidents(spark, d), ["Record_ID"]).select("Record_ID", "geo_county", "Date_Start")


@query(
    "available_filters",
    f"""WITH {RAW_INCIDENTS}
    SELECT DISTINCT 'county' AS filter, geo_county AS option FROM raw
    UNION ALL SELECT DISTINCT 'subcounty', geo_subcounty FROM raw
    UNION ALL SELECT DISTINCT 'topic', CAST(topic_id AS VARCHAR) FROM raw WHERE topic_id <> -1
    UNION ALL SELECT DISTINCT 'domain', conflict_domain FROM raw
    UNION ALL SELECT 'year_min', CAST(min(year(o_orderdate)) AS VARCHAR) FROM orders
    UNION ALL SELECT 'year_max', CAST(max(year(o_orderdate)) AS VARCHAR) FROM orders
    UNION ALL SELECT 'horizon_months', CAST(unnest([3, 6, 9, 12, 15, 18, 21, 24]) AS VARCHAR)
    UNION ALL SELECT 'n_unparseable_dates',
      CAST(count(*) FILTER ("Date_Start" IS NOT NULL AND try_strptime("Date_Start", '%m/%d/%Y') IS NULL) AS VARCHAR) FROM raw""",
)
def available_filters(spark, d):
    raw = raw_incidents(spark, d).withColumn("known_topic", F.when(F.col("topic_id") != -1, F.col("topic_id")))
    years = table(spark, d, "orders").select(F.year("o_orderdate").alias("Year"))
    return S.available_filters(
        years,
        raw,
        {
            "county": (raw, "geo_county"),
            "subcounty": (raw, "geo_subcounty"),
            "topic": (raw, "known_topic"),
            "domain": (raw, "conflict_domain"),
        },
        raw_date="Date_Start",
    )


@query(
    "extent",
    """SELECT round(min(embedding[1]::DOUBLE * 100), 4) AS min_lon, round(max(embedding[1]::DOUBLE * 100), 4) AS max_lon,
              round(min(embedding[2]::DOUBLE * 100), 4) AS min_lat, round(max(embedding[2]::DOUBLE * 100), 4) AS max_lat
    FROM embeddings WHERE label = 3""",
)
def extent(spark, d):
    points = table(spark, d, "embeddings").select(
        "label", (F.col("embedding")[0].cast("double") * 100).alias("lon"), (F.col("embedding")[1].cast("double") * 100).alias("lat")
    )
    box = S.selection_extent(points, points, "lon", "lat", area=3, area_col="label")
    return box.select(*[F.round(c, 4).alias(c) for c in box.columns])


@query(
    "coverage_report",
    """SELECT 'orders' AS step, o_orderstatus AS part, count(*) AS n, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS latest
    FROM orders GROUP BY ALL
    UNION ALL SELECT 'lineitem', l_linestatus, count(*), CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) FROM lineitem GROUP BY ALL""",
)
def coverage_report(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderstatus").alias("part"), F.to_date("o_orderdate").alias("day"))
    lines = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("part"), F.to_date("l_shipdate").alias("day"))
    return S.coverage_report({"orders": orders, "lineitem": lines}, "part", "day")
