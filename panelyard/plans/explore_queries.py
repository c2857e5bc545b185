"""Trend, seasonality, cross-tab and chart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators import explore as X
from panelyard.operators import serve as S
from panelyard.plans.inputs import INCIDENTS, PANEL, incidents, panel, r6
from panelyard.plans.registry import query, table



def dated(spark, d):
    """Incidents with calendar columns."""
    return incidents(spark, d).withColumns({"Year": F.year("start"), "Month": F.month("start")})


@query(
    "yearly_trend",
    """WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS n, count(DISTINCT month(o_orderdate)) AS m
                  FROM orders GROUP BY 1)
    SELECT round(regr_slope(n, y), 6) AS trend_slope, round(regr_r2(n, y), 6) AS trend_r_squared, count(*) AS n
    FROM y WHERE m = 12""",
)
def yearly_trend(spark, d):
    yearly = X.yearly_trend(dated(spark, d), F.lit(1), "n_events", complete_years_only=True)
    return X.linear_trend(yearly, "n_events").select(r6("trend_slope"), r6("trend_r_squared"), "n")


@query("trend_pvalue")
def trend_pvalue(spark, d):
    yearly = X.yearly_trend(dated(spark, d), F.col("severity"), "severity", complete_years_only=True)
    return X.linear_trend(yearly, "severity")


@query(
    "yearly_totals",
    """SELECT CAST(year(o_orderdate) AS INT) AS "Year", count(*) AS n_events,
              count(DISTINCT month(o_orderdate)) AS n_months FROM orders GROUP BY 1""",
)
def yearly_totals(spark, d):
    return X.yearly_trend(dated(spark, d), F.lit(1), "n_events")


@query(
    "area_yearly_trend",
    f"""WITH {INCIDENTS}
    SELECT n_regionkey AS county, CAST(year(start) AS INT) AS "Year", round(sum(severity), 4) AS severity,
           count(DISTINCT month(start)) AS n_months
    FROM incidents JOIN nation ON area = n_nationkey GROUP BY 1, 2""",
)
def area_yearly_trend(spark, d):
    regions = table(spark, d, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("county"))
    by_county = X.yearly_trend(dated(spark, d).join(regions, "area"), F.col("severity"), "severity", ["county"])
    return by_county.withColumn("severity", F.round("severity", 4))


@query(
    "seasonal_pattern",
    f"""WITH {PANEL}
    SELECT "Month", round(sum(conflict_persistence), 4) AS conflict_persistence_total,
           round(avg(conflict_persistence), 6) AS conflict_persistence_mean,
           round(stddev_samp(conflict_persistence), 6) AS conflict_persistence_std
    FROM panel GROUP BY 1""",
)
def seasonal_pattern(spark, d):
    monthly = X.seasonal_pattern(panel(spark, d), F.col("conflict_persistence"), "conflict_persistence")
    return monthly.select(
        "Month", F.round("conflict_persistence_total", 4).alias("conflict_persistence_total"),
        r6("conflict_persistence_mean"), r6("conflict_persistence_std"),
    )


@query(
    "area_summary",
    f"""WITH {PANEL}
    SELECT county, area, sum(CAST(conflict_onset AS INT))::BIGINT AS total_onset_months,
           round(avg(conflict_persistence), 6) AS conflict_persistence,
           round(avg(conflict_severity_weighted), 6) AS conflict_severity_weighted
    FROM panel GROUP BY 1, 2""",
)
def area_summary(spark, d):
    summary = X.area_summary(
        panel(spark, d), ["county", "area"], ["conflict_persistence", "conflict_severity_weighted"]
    )
    return summary.select(
        "county", "area", "total_onset_months", r6("conflict_persistence"), r6("conflict_severity_weighted")
    )


@query(
    "value_counts",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM orders GROUP BY 1, 2""",
)
def value_counts(spark, d):
    counts = X.value_counts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return counts.withColumn("share", F.round("share", 6))


@query(
    "crosstab",
    """SELECT lang, count(*) FILTER (source = 'src0') AS src0, count(*) FILTER (source = 'src1') AS src1,
              count(*) FILTER (source = 'src2') AS src2, count(*) FILTER (source = 'src3') AS src3
    FROM documents GROUP BY 1""",
)
def crosstab(spark, d):
    return X.crosstab(table(spark, d, "documents"), "lang", "source", ["src0", "src1", "src2", "src3"])


def _chi2_sql(source: str, a: str, b: str) -> str:
    return f"""
    WITH src AS ({source}),
    cells AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS o FROM src WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
    ra AS (SELECT a, sum(o) AS r FROM cells GROUP BY 1), cb AS (SELECT b, sum(o) AS c FROM cells GROUP BY 1),
    n AS (SELECT sum(o) AS n FROM cells),
    full_table AS (SELECT ra.a, cb.b, coalesce(o, 0) AS o, r * c / n AS e
      FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b),
    dof AS (SELECT (SELECT count(*) - 1 FROM ra) * (SELECT count(*) - 1 FROM cb) AS dof)
    SELECT round(sum(CASE WHEN dof = 1 THEN (abs(o - e) - least(0.5, abs(o - e))) ** 2 ELSE (o - e) ** 2 END / e), 6) AS chi2,
           max(dof) AS dof, round(min(e), 6) AS min_expected, min(e) < 5 AS low_expected
    FROM full_table, dof"""


@query("crosstab_chi2", _chi2_sql("SELECT * FROM orders", "o_orderstatus", "o_orderpriority"))
def crosstab_chi2(spark, d):
    test = X.chi_square(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return test.select(r6("chi2"), "dof", r6("min_expected"), "low_expected")


@query(
    "crosstab_chi2_corrected",
    _chi2_sql("SELECT quality, toxic FROM labels", "quality", "toxic"),
)
def crosstab_chi2_corrected(spark, d):
    test = X.chi_square(table(spark, d, "labels"), "quality", "toxic")
    return test.select(r6("chi2"), "dof", r6("min_expected"), "low_expected")


@query("chi2_pvalue")
def chi2_pvalue(spark, d):
    return X.chi_square(table(spark, d, "documents"), "lang", "source")


@query(
    "severity_by_domain",
    f"""WITH {INCIDENTS}
    SELECT topic, count(severity) AS n, round(avg(severity), 6) AS mean,
           round(quantile_cont(severity, 0.5), 6) AS median, round(stddev_samp(severity), 6) AS std
    FROM incidents GROUP BY 1""",
)
def severity_by_domain(spark, d):
    summary = X.group_severity(incidents(spark, d), "topic", "severity")
    return summary.select("topic", "n", r6("mean"), r6("median"), r6("std"))


@query(
    "year_counts",
    f"""WITH {INCIDENTS}
    SELECT CAST(year(start) AS INT) AS year, count(*) AS count, round(avg(severity), 6) AS avg_severity
    FROM incidents GROUP BY 1""",
)
def year_counts(spark, d):
    return S.counts_by_year(incidents(spark, d), F.col("start"), "severity").withColumn("avg_severity", F.round("avg_severity", 6))


@query(
    "month_counts_12",
    """WITH m AS (SELECT unnest(range(1, 13))::INT AS month),
    c AS (SELECT month(ts)::INT AS month, count(*) AS n FROM events GROUP BY 1)
    SELECT m.month, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][m.month] AS month_label,
           coalesce(c.n, 0) AS count FROM m LEFT JOIN c ON c.month = m.month""",
)
def month_counts_12(spark, d):
    return S.counts_by_month(table(spark, d, "events"), F.col("ts"))


@query(
    "incident_summary",
    f"""WITH {INCIDENTS}
    SELECT count(*) AS n_records, count(*) FILTER (composite) AS n_composite, round(avg(severity), 6) AS avg_severity
    FROM incidents""",
)
def incident_summary(spark, d):
    return S.incident_summary(incidents(spark, d), "composite", "severity").withColumn(
        "avg_severity", F.round("avg_severity", 6)
    )


@query(
    "topic_counts",
    """WITH t AS (SELECT DISTINCT source FROM documents), c AS (
      SELECT d.source, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1 GROUP BY 1)
    SELECT t.source, coalesce(c.n, 0) AS n_records FROM t LEFT JOIN c ON c.source = t.source""",
)
def topic_counts(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    toxic = docs.join(labels.filter("toxic = 1"), "doc_id", "left_semi")
    return S.live_topic_counts(toxic, docs.select("source").distinct(), "source")


@query(
    "semi_live_topics",
    """SELECT DISTINCT source FROM documents WHERE source IN (
      SELECT d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1 AND l.quality = 0)""",
)
def semi_live_topics(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    alive = docs.join(labels.filter("toxic = 1 AND quality = 0"), "doc_id", "left_semi")
    return S.live_topics(docs.select("source").distinct(), alive, "source")


@query(
    "chart_pivot",
    """WITH m AS (SELECT round(l_discount, 2) AS x, l_returnflag AS model, round(avg(l_quantity), 6) AS v
                  FROM lineitem GROUP BY ALL)
    SELECT x, min(v) FILTER (model = 'A') AS A, min(v) FILTER (model = 'N') AS N, min(v) FILTER (model = 'R') AS R
    FROM m GROUP BY 1""",
)
def chart_pivot(spark, d):
    means = table(spark, d, "lineitem").groupBy(F.round("l_discount", 2).alias("x"), "l_returnflag").agg(
        F.round(F.avg("l_quantity"), 6).alias("v")
    )
    return S.chart_pivot(means, F.col("x"), "x", "l_returnflag", ["A", "N", "R"], "v")
