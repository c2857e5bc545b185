import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.functions import stats
from panelyard.operators import explore as X
from panelyard.operators import metrics as M
from panelyard.operators import risk as K


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    s = np.round(rng.uniform(0, 1, 400), 2)
    y = (rng.uniform(0, 1, 400) < s * 0.5).astype(int)
    rows = [("m1" if i < 250 else "m2", float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))]
    rows += [("one", 0.3, 0), ("one", 0.4, 0)]
    return spark.createDataFrame(rows, "model string, s double, y int").repartition(6), rows


def arrays(rows, model):
    return np.array([r[1] for r in rows if r[0] == model]), np.array([r[2] for r in rows if r[0] == model])


def test_ranking_scores(scored):
    df, rows = scored
    got = {r["model"]: r for r in M.ranking_scores(df, "s", "y", ["model"]).collect()}
    for m in ("m1", "m2"):
        s, y = arrays(rows, m)
        p, n = s[y == 1], s[y == 0]
        auc = ((p[:, None] > n[None, :]) + 0.5 * (p[:, None] == n[None, :])).mean()
        ap, last = 0.0, 0.0
        for t in sorted(set(s), reverse=True):
            tp = (y[s >= t] == 1).sum()
            ap, last = ap + (tp / y.sum() - last) * tp / (s >= t).sum(), tp / y.sum()
        assert math.isclose(got[m]["roc_auc"], auc, rel_tol=1e-12) and math.isclose(got[m]["pr_auc"], ap, rel_tol=1e-12)
    assert got["one"]["roc_auc"] is None and got["one"]["pr_auc"] is None


def test_threshold_and_evaluation(scored, spark):
    df, rows = scored
    cuts = M.best_threshold(df, "s", "y", ["model"])
    got = {r["model"]: r["threshold"] for r in cuts.collect()}
    for m in ("m1", "m2"):
        s, y = arrays(rows, m)

        def f1(t):
            tp = ((s >= t) & (y == 1)).sum()
            p, r = tp / (s >= t).sum(), tp / y.sum()
            return 2 * p * r / (p + r + 1e-12) if p + r else 0.0

        top = max(f1(t) for t in set(s))
        assert got[m] == min(t for t in set(s) if math.isclose(f1(t), top, rel_tol=1e-13))
    assert got["one"] == 0.5
    full = {(r["model"], r["threshold_kind"]): r for r in M.evaluate(df, "s", "y", ["model"], cuts).collect()}
    assert len(full) == 6 and full["m1", "tuned"]["f1"] >= full["m1", "default"]["f1"]
    assert full["one", "default"]["true_negative"] == 2 and full["one", "default"]["precision"] == 0
    assert full["one", "default"]["accuracy"] == 1


def test_ungrouped_metrics(scored):
    df, rows = scored
    one = M.ranking_scores(df.filter("model = 'm1'"), "s", "y").collect()
    assert len(one) == 1 and 0.5 < one[0]["roc_auc"] < 1


def test_calibration(scored):
    df, rows = scored
    got = M.calibration(df, "s", "y", ["model"], 10).collect()
    assert "one" not in {r["model"] for r in got}
    s, y = arrays(rows, "m1")
    edges = np.quantile(s, np.linspace(0, 1, 11))
    which = np.searchsorted(edges[1:-1], s)
    for r in got:
        if r["model"] == "m1":
            hit = which == r["bin"]
            assert r["bin_count"] == hit.sum() and math.isclose(r["fraction_of_positives"], y[hit].mean(), abs_tol=1e-12)


@pytest.mark.parametrize(
    "values,labels",
    [
        ([1, 2, 3, 4, 5, 6], ["Low", "Low", "Medium", "Medium", "High", "High"]),
        ([0, 0, 0, 0, 1, 2], None),
        ([0, 0, 0, 0, 0, 2], ["Uniform"] * 6),
        ([1, 1, 1, 1, 1, 1], ["Uniform"] * 6),
    ],
)
def test_tertiles(spark, values, labels):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(99, None)], "id int, p double")
    got = [r["risk_category"] for r in M.tertiles(df, "p").orderBy("id").collect()]
    assert got[-1] is None
    if labels:
        assert got[:-1] == labels
    else:  # tertile edges 0, 0, 1/3.., 2 collapse, the median edge as well
        assert set(got[:-1]) <= {"Lower", "Higher", "Uniform"}


def test_two_bins_when_thirds_collapse(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 0.0, 1.0, 1.0, 1.0])], "id int, p double")
    got = [r["risk_category"] for r in M.tertiles(df, "p").orderBy("id").collect()]
    assert len(set(got)) <= 2


def test_risk_layer_keeps_every_area(spark):
    panel = spark.createDataFrame(
        [("C", "a", "2020-01-01", 1.0), ("C", "a", "2020-02-01", None), ("C", "b", "2020-02-01", 3.0), ("C", "c", "2020-01-01", None)],
        "County string, SubCounty string, panel_date string, f double",
    )
    shapes = spark.createDataFrame([("C", n) for n in "abcd"], "County string, SubCounty string")
    layer = K.risk_layer(shapes, panel, ["County", "SubCounty"], ["f"], lambda d: d.withColumn("risk_probability", F.col("f") / 10))
    got = {r["SubCounty"]: (r["target_month"], r["risk_probability"]) for r in layer.collect()}
    assert got == {"a": ("2020-01-01", 0.1), "b": ("2020-02-01", 0.3), "c": (None, None), "d": (None, None)}
    assert [r["SubCounty"] for r in K.top_risk(layer, ["SubCounty"]).collect()] == ["b", "a"]


def test_tail_probabilities():
    assert math.isclose(stats.t_two_sided(2.228138852, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(stats.t_two_sided(0.0, 3), 1.0)
    assert math.isclose(stats.chi2_tail(3.841458821, 1), 0.05, rel_tol=1e-7)
    assert math.isclose(stats.chi2_tail(18.307038, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(stats.chi2_tail(60.0, 10), 3.6e-9, rel_tol=0.05)


def test_trend(spark):
    yearly = spark.createDataFrame([(2000 + i, float(v)) for i, v in enumerate([1, 3, 2, 5, 4])], "Year int, v double")
    got = X.linear_trend(yearly, "v").first()
    assert math.isclose(got["trend_slope"], 0.8) and math.isclose(got["trend_r_squared"], 0.64)
    assert math.isclose(got["trend_pvalue"], 0.1041, abs_tol=1e-4)
    exact = X.linear_trend(yearly.withColumn("v", F.col("Year") * 2.0), "v").first()
    assert exact["trend_pvalue"] == 0.0 or exact["trend_pvalue"] < 1e-9
    short = X.linear_trend(yearly.limit(2), "v").first()
    assert short["n"] == 2 and short["trend_pvalue"] is None


def test_complete_years_only(spark):
    panel = spark.createDataFrame([(2020, m, 1.0) for m in range(1, 13)] + [(2021, 1, 9.0)], "Year int, Month int, v double")
    assert X.yearly_trend(panel, F.col("v"), "v").count() == 2
    assert [tuple(r) for r in X.yearly_trend(panel, F.col("v"), "v", complete_years_only=True).collect()] == [(2020, 12.0, 12)]


def test_chi_square(spark):
    def table(counts):
        return spark.createDataFrame([(a, b) for (a, b), n in counts.items() for _ in range(n)], "a string, b string")

    got = X.chi_square(table({("x", "p"): 10, ("x", "q"): 20, ("y", "p"): 30, ("y", "q"): 5}), "a", "b").first()
    by_hand = 65 * (abs(10 * 5 - 20 * 30) - 65 / 2) ** 2 / (30 * 35 * 40 * 25)
    assert math.isclose(got["chi2"], by_hand, rel_tol=1e-12) and got["dof"] == 1 and got["p_value"] < 1e-4
    plain = X.chi_square(table({("x", "p"): 10, ("x", "q"): 20, ("y", "p"): 30, ("y", "q"): 5}), "a", "b", correction=False).first()
    assert plain["chi2"] > got["chi2"]
    sparse = X.chi_square(table({("x", "p"): 3, ("y", "q"): 3, ("z", "q"): 1}), "a", "b").first()
    assert math.isclose(sparse["chi2"], 7.0) and sparse["dof"] == 2 and sparse["low_expected"]
    assert X.chi_square(table({("x", "p"): 3, ("x", "q"): 3}), "a", "b").count() == 0


def test_crosstab_and_counts(spark):
    df = spark.createDataFrame([("a", "u"), ("a", "u"), ("b", "v"), ("b", None)], "r string, c string")
    assert sorted(map(tuple, X.crosstab(df, "r", "c").collect())) == [("a", 2, 0), ("b", 0, 1)]
    with pytest.raises(ValueError):
        X.crosstab(df, "r", "c", max_columns=1)
    assert [(r["r"], r["n"], r["share"]) for r in X.value_counts(df, "r").collect()] == [("a", 2, 0.5), ("b", 2, 0.5)]
