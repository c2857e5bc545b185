"""Classifier metrics on scored rows: confusion, ROC, average precision, thresholds, calibration.

All work per group (``by``: model, horizon, ...) and fold equal scores into one
row first, so nothing is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.ordering import attach, exact_quantiles, running_totals


def _share(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion(df: DataFrame, label: str, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """All four counts, even when only one class occurs."""
    pos = F.col(label).cast("int") == 1
    return df.groupBy(*by).agg(
        F.count_if(~pos & ~predicted).alias("true_negative"),
        F.count_if(~pos & predicted).alias("false_positive"),
        F.count_if(pos & ~predicted).alias("false_negative"),
        F.count_if(pos & predicted).alias("true_positive"),
        F.count(F.lit(1)).alias("total"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from the four counts; 0 on zero division."""
    tp, fp, fn, tn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative"))
    return counts.withColumns(
        {
            "accuracy": _share(tp + tn, F.col("total")),
            "precision": _share(tp, tp + fp),
            "recall": _share(tp, tp + fn),
            "f1": _share(2 * tp, 2 * tp + fp + fn),
        }
    )


def _ladder(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Per distinct score from high to low: positives and negatives at and above it."""
    pos = (F.col(label).cast("int") == 1).cast("long")
    return running_totals(df, score, {"tp": pos, "fp": 1 - pos}, by, descending=True)


def roc_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return _ladder(df, score, label, by).select(
        *by, F.col(score).alias("threshold"),
        _share(F.col("cum_fp"), F.col("all_fp")).alias("fpr"), _share(F.col("cum_tp"), F.col("all_tp")).alias("tpr"),
    )


def pr_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return _ladder(df, score, label, by).select(
        *by, F.col(score).alias("threshold"),
        _share(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp")).alias("precision"),
        _share(F.col("cum_tp"), F.col("all_tp")).alias("recall"),
    )


def ranking_scores(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision (steps, not trapezoids); null with one class."""
    steps = _ladder(df, score, label, by)
    below = F.col("all_fp") - F.col("cum_fp")
    both = (F.max("all_tp") > 0) & (F.max("all_fp") > 0)
    auc = F.sum(F.col("tp") * (below + F.col("fp") / 2)) / F.nullif(
        (F.max("all_tp") * F.max("all_fp")).cast("double"), F.lit(0.0)
    )
    ap = F.sum(F.col("tp") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))) / F.nullif(
        F.max("all_tp").cast("double"), F.lit(0.0)
    )
    return steps.groupBy(*by).agg(F.when(both, auc).alias("roc_auc"), F.when(both, ap).alias("pr_auc"))


def best_threshold(df: DataFrame, score: str, label: str, by: Sequence[str] = (), default: float = 0.5) -> DataFrame:
    """The score with the highest F1, the lowest one on ties, ``default`` when no F1 is above 0."""
    curve = pr_curve(df, score, label, by)
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r + F.lit(1e-12))).otherwise(F.lit(0.0))
    top = curve.withColumn("_f1", f1).groupBy(*by).agg(
        F.max("_f1").alias("_best"), F.min_by("threshold", F.struct(-F.col("_f1"), F.col("threshold"))).alias("_at")
    )
    return top.select(*by, F.when(F.col("_best") > 0, F.col("_at")).otherwise(F.lit(default)).alias("threshold"))


def evaluate(df: DataFrame, score: str, label: str, by: Sequence[str], thresholds: DataFrame | None = None) -> DataFrame:
    """Every metric at 0.5 and, when given, at the tuned threshold of each group."""
    fixed = df.select(*by, score, label, F.lit("default").alias("threshold_kind"), F.lit(0.5).alias("threshold"))
    rows = fixed
    if thresholds is not None:
        tuned = attach(df.select(*by, score, label), thresholds, by)
        rows = fixed.unionByName(tuned.withColumn("threshold_kind", F.lit("tuned")))
    keys = [*by, "threshold_kind", "threshold"]
    flat = rates(confusion(rows, label, F.col(score) >= F.col("threshold"), keys))
    return attach(flat, ranking_scores(df, score, label, by), by)


def calibration(df: DataFrame, score: str, label: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Reliability table over quantile bins; empty for groups with one class."""
    positive = (F.col(label).cast("int") == 1).cast("double")
    edges = exact_quantiles(df, score, [i / bins for i in range(1, bins)], by, "_edges")
    classes = df.groupBy(*by).agg(F.avg(positive).alias("_rate"))
    known = attach(attach(df.select(*by, score, label), edges, by), classes, by).filter(
        (F.col("_rate") > 0) & (F.col("_rate") < 1) & F.col(score).isNotNull()
    )
    bin_no = F.size(F.filter("_edges", lambda e: e < F.col(score)))
    return (
        known.withColumn("bin", bin_no)
        .groupBy(*by, "bin")
        .agg(
            F.avg(score).alias("mean_predicted_probability"),
            F.avg(positive).alias("fraction_of_positives"),
            F.count(F.lit(1)).alias("bin_count"),
        )
    )


def quantile_bin(value: Column, edges: Column, low: int) -> Column:
    """Right-closed bin number below ``edges``, after equal edges are merged; the lowest value included."""
    inner = F.filter(F.array_distinct(edges), lambda e: e > edges[low])
    return F.size(F.filter(inner, lambda e: e < value))


def tertiles(df: DataFrame, value: str, out: str = "risk_category", by: Sequence[str] = ()) -> DataFrame:
    """Low, Medium, High by tertiles; Lower, Higher when edges coincide; Uniform when all values agree."""
    cuts = exact_quantiles(df, value, [0.0, 1 / 3, 0.5, 2 / 3, 1.0], by, "_q")
    q = F.col("_q")
    with_edges = attach(df, cuts, by).withColumns(
        {"_three": F.array(q[0], q[1], q[3], q[4]), "_two": F.array(q[0], q[2], q[4])}
    ).drop("_q")
    v = F.col(value)
    third = quantile_bin(v, F.col("_three"), 0)
    half = quantile_bin(v, F.col("_two"), 0)
    n3, n2 = F.size(F.array_distinct("_three")), F.size(F.array_distinct("_two"))
    label = (
        F.when(v.isNull(), F.lit(None))
        .when(n3 == 4, F.get(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), third))
        .when(n2 == 3, F.get(F.array(F.lit("Lower"), F.lit("Higher")), half))
        .otherwise(F.lit("Uniform"))
    )
    rank = F.when(n3 == 4, third).when(n2 == 3, half).when(v.isNotNull(), F.lit(0))
    return with_edges.withColumns({out: label, f"{out}_rank": rank}).drop("_three", "_two")


def scaler_params(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column (0 deviation becomes 1), long form."""
    aggs = []
    for c in columns:
        aggs.append(
            F.struct(
                F.lit(c).alias("column_name"), F.avg(c).alias("mean"),
                F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias("scale"),
            ).alias(c)
        )
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*columns)).alias("p")).select("p.*")


def class_balance(df: DataFrame, split: str, label: str) -> DataFrame:
    y = F.col(label).cast("int")
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("positives"), F.avg(y.cast("double")).alias("positive_rate")
    )
