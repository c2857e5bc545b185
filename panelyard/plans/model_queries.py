"""Metric, risk and forecasting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators import forecast as G
from panelyard.operators import metrics as M
from panelyard.operators import risk as K
from panelyard.plans.inputs import PANEL, panel, r6
from panelyard.plans.registry import query, table


def scored(spark, d):
    """Labelled documents with a score from their length; source parity stands for two models."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    rows = table(spark, d, "labels").join(docs, "doc_id")
    return rows.select(
        "doc_id", "quality", F.round(F.log1p("n_chars") / 12, 2).alias("score"),
        F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("model"),
    )


SCORED = """
scored AS (SELECT l.doc_id, quality, round(ln(1 + n_chars) / 12, 2) AS score, CASE WHEN l.doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""

LADDER = f"""{SCORED},
per_score AS (SELECT model, score, sum((quality = 1)::INT) AS tp, sum((quality <> 1)::INT) AS fp FROM scored GROUP BY ALL),
ladder AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER (PARTITION BY model) AS atp, sum(fp) OVER (PARTITION BY model) AS afp
  FROM per_score WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""


@query(
    "confusion",
    f"""WITH {SCORED}, c AS (SELECT model, count(*) FILTER (quality <> 1 AND score < 0.6) AS true_negative,
      count(*) FILTER (quality <> 1 AND score >= 0.6) AS false_positive, count(*) FILTER (quality = 1 AND score < 0.6) AS false_negative,
      count(*) FILTER (quality = 1 AND score >= 0.6) AS true_positive, count(*) AS total FROM scored GROUP BY 1)
    SELECT *, round((true_positive + true_negative) / total, 6) AS accuracy,
      round(coalesce(true_positive / nullif(true_positive + false_positive, 0), 0), 6) AS precision,
      round(coalesce(true_positive / nullif(true_positive + false_negative, 0), 0), 6) AS recall,
      round(coalesce(2 * true_positive / nullif(2 * true_positive + false_positive + false_negative, 0), 0), 6) AS f1 FROM c""",
)
def confusion(spark, d):
    counts = M.rates(M.confusion(scored(spark, d), "quality", F.col("score") >= 0.6, ["model"]))
    plain = ["model", "true_negative", "false_positive", "false_negative", "true_positive", "total"]
    return counts.select(*plain, r6("accuracy"), r6("precision"), r6("recall"), r6("f1"))


@query(
    "roc_curve",
    f"""WITH {LADDER} SELECT model, score AS threshold, round(cfp / afp, 6) AS fpr, round(ctp / atp, 6) AS tpr FROM ladder""",
)
def roc_curve(spark, d):
    return M.roc_curve(scored(spark, d), "score", "quality", ["model"]).select("model", "threshold", r6("fpr"), r6("tpr"))


@query(
    "pr_curve",
    f"""WITH {LADDER} SELECT model, score AS threshold, round(ctp / (ctp + cfp), 6) AS precision, round(ctp / atp, 6) AS recall FROM ladder""",
)
def pr_curve(spark, d):
    return M.pr_curve(scored(spark, d), "score", "quality", ["model"]).select("model", "threshold", r6("precision"), r6("recall"))


@query(
    "roc_auc",
    f"""WITH {SCORED}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored),
    n AS (SELECT sum((quality = 1)::INT)::DOUBLE AS p, sum((quality <> 1)::INT)::DOUBLE AS q, sum(rk) FILTER (quality = 1) AS s FROM r)
    SELECT round((s - p * (p + 1) / 2) / (p * q), 6) AS roc_auc FROM n""",
)
def roc_auc(spark, d):
    return M.ranking_scores(scored(spark, d), "score", "quality").select(r6("roc_auc"))


@query(
    "average_precision",
    f"""WITH {LADDER} SELECT model, round(sum(tp * ctp / (ctp + cfp)) / max(atp), 6) AS pr_auc FROM ladder GROUP BY 1""",
)
def average_precision(spark, d):
    return M.ranking_scores(scored(spark, d), "score", "quality", ["model"]).select("model", r6("pr_auc"))


F1 = f"""{LADDER}, f AS (SELECT model, score, 2 * (ctp / (ctp + cfp)) * (ctp / atp) / (ctp / (ctp + cfp) + ctp / atp + 1e-12) AS f1
  FROM ladder WHERE ctp > 0),
best AS (SELECT model, score AS threshold FROM f QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score) = 1)"""


@query("best_threshold", f"WITH {F1} SELECT model, threshold FROM best")
def best_threshold(spark, d):
    return M.best_threshold(scored(spark, d), "score", "quality", ["model"])


@query(
    "evaluate_model",
    f"""WITH {F1}, both_cuts AS (SELECT model, 'default' AS threshold_kind, 0.5::DOUBLE AS threshold FROM best
        UNION ALL SELECT model, 'tuned', threshold FROM best),
    c AS (SELECT s.model, threshold_kind, threshold, sum((quality = 1 AND score >= threshold)::INT)::DOUBLE AS tp,
      sum((quality <> 1 AND score >= threshold)::INT)::DOUBLE AS fp, sum((quality = 1 AND score < threshold)::INT)::DOUBLE AS fn, count(*) AS total
      FROM scored s JOIN both_cuts b ON b.model = s.model GROUP BY ALL),
    auc AS (SELECT model, sum(tp * (afp - cfp + fp / 2)) / (max(atp) * max(afp)) AS auc FROM ladder GROUP BY 1)
    SELECT c.model, threshold_kind, threshold, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
           round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(auc, 6) AS roc_auc, total
    FROM c JOIN auc ON auc.model = c.model""",
)
def evaluate_model(spark, d):
    rows = scored(spark, d)
    cuts = M.best_threshold(rows, "score", "quality", ["model"])
    full = M.evaluate(rows, "score", "quality", ["model"], cuts)
    return full.select("model", "threshold_kind", "threshold", r6("precision"), r6("recall"), r6("roc_auc"), "total")


@query(
    "calibration",
    f"""WITH {SCORED}, e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM scored),
    b AS (SELECT quality, score, len(list_filter(edges, lambda x: x < score)) AS bin FROM scored, e)
    SELECT bin, round(avg(score), 6) AS mean_predicted_probability, round(avg((quality = 1)::INT), 6) AS fraction_of_positives, count(*) AS bin_count
    FROM b GROUP BY 1""",
)
def calibration(spark, d):
    table_ = M.calibration(scored(spark, d), "score", "quality")
    return table_.select("bin", r6("mean_predicted_probability"), r6("fraction_of_positives"), "bin_count")


@query(
    "tertile_risk",
    """WITH e AS (SELECT quantile_cont(o_totalprice, [1/3, 2/3]) AS q FROM orders)
    SELECT o_orderkey, CASE WHEN o_totalprice <= q[1] THEN 'Low' WHEN o_totalprice <= q[2] THEN 'Medium' ELSE 'High' END AS risk_category,
           CASE WHEN o_totalprice <= q[1] THEN 0 WHEN o_totalprice <= q[2] THEN 1 ELSE 2 END AS risk_category_rank
    FROM orders, e""",
)
def tertile_risk(spark, d):
    binned = M.tertiles(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
    return binned.select("o_orderkey", "risk_category", "risk_category_rank")


@query(
    "scaler_params",
    """SELECT 'l_quantity' AS column_name, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS scale FROM lineitem
    UNION ALL SELECT 'l_extendedprice', round(avg(l_extendedprice), 6), round(stddev_pop(l_extendedprice), 6) FROM lineitem""",
)
def scaler_params(spark, d):
    params = M.scaler_params(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return params.select("column_name", r6("mean"), r6("scale"))


# --- panel preparation --------------------------------------------------------------------

LAGGED = f"""{PANEL},
lagged AS (SELECT *, lag(conflict_persistence, 6) OVER w AS p6, lag(conflict_severity_weighted, 6) OVER w AS s6
  FROM panel WINDOW w AS (PARTITION BY area ORDER BY panel_date))"""


@query("lag_features", f"WITH {LAGGED} SELECT area, panel_date, round(p6, 6) AS conflict_persistence_lag6 FROM lagged")
def lag_features(spark, d):
    lagged = G.add_lags(panel(spark, d), "area", ["conflict_persistence", "not_there"], 6)
    return lagged.select("area", "panel_date", r6("conflict_persistence_lag6"))


def horizon_table(spark, d, months=6):
    return G.modelling_table(panel(spark, d), months, "area", ["conflict_persistence", "conflict_severity_weighted"], [])


@query(
    "model_columns",
    f"""WITH {LAGGED} SELECT area, panel_date, "Year", round(p6, 6) AS conflict_persistence_lag6,
      round(s6, 6) AS conflict_severity_weighted_lag6, conflict_onset::INT AS label FROM lagged WHERE p6 IS NOT NULL AND s6 IS NOT NULL""",
)
def model_columns(spark, d):
    rows, features = horizon_table(spark, d)
    return rows.select("area", "panel_date", "Year", *[r6(f) for f in features], "label")


@query(
    "temporal_split",
    f"""WITH {LAGGED} SELECT CASE WHEN "Year" < 2000 THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(panel_date) AS first_month,
      max(panel_date) AS last_month FROM lagged WHERE p6 IS NOT NULL GROUP BY 1""",
)
def temporal_split(spark, d):
    train, test = G.temporal_split(horizon_table(spark, d)[0], 2000)
    tagged = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return tagged.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("panel_date").alias("first_month"), F.max("panel_date").alias("last_month")
    )


@query(
    "class_balance",
    f"""WITH {LAGGED} SELECT CASE WHEN "Year" < 2000 THEN 'train' ELSE 'test' END AS split, count(*) AS n,
      sum(conflict_onset::INT)::BIGINT AS positives, round(avg(conflict_onset::INT), 6) AS positive_rate
    FROM lagged WHERE p6 IS NOT NULL GROUP BY 1""",
)
def class_balance(spark, d):
    rows = horizon_table(spark, d)[0].withColumn("split", F.when(F.col("Year") < 2000, "train").otherwise("test"))
    balance = M.class_balance(rows, "split", "label")
    return balance.select("split", "n", "positives", r6("positive_rate"))


@query(
    "time_folds",
    f"""WITH {PANEL}, f AS (SELECT panel_date, ntile(6) OVER (ORDER BY panel_date) - 1 AS fold FROM (SELECT DISTINCT panel_date FROM panel))
    SELECT fold, count(*) AS n, min(p.panel_date) AS first_month, max(p.panel_date) AS last_month
    FROM panel p JOIN f ON f.panel_date = p.panel_date GROUP BY 1""",
)
def time_folds(spark, d):
    folded = G.time_folds(panel(spark, d), 5)
    return folded.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("panel_date").alias("first_month"), F.max("panel_date").alias("last_month")
    )


def gappy_panel(spark, d):
    """The panel with persistence unknown in recent months of some areas."""
    gap = (F.col("panel_date") > F.lit("2001-03-01").cast("date")) & (F.col("area") % 3 == 0)
    return panel(spark, d).withColumn("conflict_persistence", F.when(~gap, F.col("conflict_persistence")))


GAPPY = f"""{PANEL},
latest AS (SELECT area, county, panel_date, conflict_persistence FROM panel
  WHERE NOT (panel_date > DATE '2001-03-01' AND area % 3 = 0)
  QUALIFY row_number() OVER (PARTITION BY area ORDER BY panel_date DESC) = 1)"""


@query(
    "latest_complete",
    f"WITH {GAPPY} SELECT area, panel_date, round(conflict_persistence, 6) AS conflict_persistence FROM latest",
)
def latest_complete(spark, d):
    last = K.latest_complete(gappy_panel(spark, d), ["area", "county"], ["conflict_persistence"])
    return last.select("area", "panel_date", r6("conflict_persistence"))


RISK = f"""{GAPPY},
scored AS (SELECT area, county, panel_date, 1 / (1 + exp(-(conflict_persistence - 20) / 5)) AS p FROM latest),
cuts AS (SELECT quantile_cont(p, [1/3, 2/3]) AS q FROM scored),
layer AS (SELECT n_nationkey AS area, n_name, s.panel_date AS target_month, round(p, 6) AS risk_probability,
    CASE WHEN p <= q[1] THEN 'Low' WHEN p <= q[2] THEN 'Medium' WHEN p > q[2] THEN 'High' END AS risk_category
  FROM nation CROSS JOIN cuts LEFT JOIN scored s ON s.area = n_nationkey AND s.county = n_regionkey)"""


def layer(spark, d):
    shapes = table(spark, d, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("county"), "n_name")

    def score(df):
        p = 1 / (1 + F.exp(-(F.col("conflict_persistence") - 20) / 5))
        return df.withColumn("risk_probability", p)

    return K.risk_layer(shapes, gappy_panel(spark, d), ["area", "county"], ["conflict_persistence"], score)


@query("risk_layer", f"WITH {RISK} SELECT * FROM layer")
def risk_layer(spark, d):
    return layer(spark, d).select("area", "n_name", "target_month", r6("risk_probability"), "risk_category")


@query(
    "top_risk",
    f"WITH {RISK} SELECT area, risk_probability FROM layer WHERE risk_probability IS NOT NULL ORDER BY risk_probability DESC, area LIMIT 5",
)
def top_risk(spark, d):
    rounded = layer(spark, d).withColumn("risk_probability", F.round("risk_probability", 6))
    return K.top_risk(rounded, ["area"]).select("area", "risk_probability")


@query(
    "geometry_inner_join",
    """SELECT n_nationkey AS area, n_regionkey AS county, round(s, 4) AS balance FROM nation JOIN (
      SELECT s_nationkey, sum(s_acctbal) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey WHERE s IS NOT NULL""",
)
def geometry_inner_join(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("county"))
    summary = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("area")).agg(F.sum("s_acctbal").alias("balance"))
    return K.with_geometry(nations, summary, ["area"], "balance").withColumn("balance", F.round("balance", 4))


@query(
    "topic_agreement",
    """WITH t AS (SELECT CASE WHEN e.vec_id % 4 = 0 THEN 'test' ELSE 'train' END AS period, e.label AS old, q.quality AS new
      FROM embeddings e LEFT JOIN labels q ON q.doc_id = e.vec_id)
    SELECT period, count(*) AS n, round(avg((old IS NOT DISTINCT FROM new)::INT), 6) AS agreement, round(avg((new = 0)::INT), 6) AS outlier_rate
    FROM t GROUP BY 1""",
)
def topic_agreement(spark, d):
    from panelyard.operators.explore import agreement_rates

    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("old"))
    new = table(spark, d, "labels").select("doc_id", F.col("quality").alias("new"))
    both = old.join(new, "doc_id", "left").withColumn("period", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train"))
    return agreement_rates(both, "period", "old", "new", 0).select("period", "n", r6("agreement"), r6("outlier_rate"))


# --- fitted models --------------------------------------------------------------------------

DYNAMIC = ["conflict_persistence", "conflict_severity_weighted"]


def forecast(spark, d, models, horizons=(6,)):
    return G.run_horizons(panel(spark, d), "area", DYNAMIC, horizons=horizons, models=models, cutoff=2000, splits=3, always=True)


@query("lr_scores")
def lr_scores(spark, d):
    out = forecast(spark, d, {"Logistic Regression": [{"C": 0.1}, {"C": 1.0, "balanced": True}]})
    return out["scores"]


@query("rf_scores")
def rf_scores(spark, d):
    out = forecast(spark, d, {"Random Forest": [{"trees": 20, "depth": 5, "leaf": 5}]})
    return out["scores"]


@query("gbt_scores")
def gbt_scores(spark, d):
    out = forecast(spark, d, {"Gradient Boosting": [{"rounds": 10, "depth": 3, "rate": 0.1, "row_share": 0.8}]})
    return out["scores"]


@query("horizon_metrics")
def horizon_metrics(spark, d):
    """Metrics of one fixed logistic setting at all eight horizons."""
    out = forecast(spark, d, {"Logistic Regression": [{"C": 1.0}]}, tuple(G.fv.HORIZONS_MONTHS))
    return out["metrics"]
