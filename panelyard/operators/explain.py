"""Feature attribution: linear terms, exact tree attribution, summaries and sentences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.labels import direction, policy_sentence
from panelyard.operators.ordering import attach
from panelyard.session import fits, scratch_path


def linear_attribution(df: DataFrame, keys: Sequence[str], coefficients: dict[str, float], background: DataFrame | None = None) -> DataFrame:
    """coefficient * (value - background mean) per row and feature, long form."""
    means = (background if background is not None else df).agg(*[F.avg(c).alias(f"_m_{c}") for c in coefficients])
    full = attach(df.select(*keys, *coefficients), means, [])
    parts = [(F.lit(b) * (F.col(c) - F.col(f"_m_{c}"))).alias(c) for c, b in coefficients.items()]
    return full.select(*keys, *parts).unpivot(list(keys), list(coefficients), "feature", "attribution")


def logistic_coefficients(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    """Coefficients per unit of the raw feature of a scaled logistic pipeline."""
    scaler, regression = model.stages[-2], model.stages[-1]
    return {f: float(b / s) if s else 0.0 for f, b, s in zip(features, regression.coefficients, scaler.std)}


# --- trees -----------------------------------------------------------------------------------

def tree_leaves(model, max_nodes: int = 2_000_000) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Every leaf of a fitted forest or boosting model as (value, conditions on the way).

    A condition is (feature, low, high, share): low < x <= high, and the share
    of training weight that takes it; conditions on one feature are merged.
    The node table is the model's own saved form.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    if not fits(nodes, max_nodes):
        raise ValueError(f"the model has more than {max_nodes} nodes")
    boosted = "GBT" in type(model).__name__
    trees: dict[int, dict[int, object]] = {}
    for row in nodes.collect():
        trees.setdefault(row["treeID"], {})[row["id"]] = row
    factors = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
    leaves = []
    for number, tree in sorted(trees.items()):
        weight_of = {i: (n["impurityStats"][0] if boosted else sum(n["impurityStats"])) for i, n in tree.items()}
        stack = [(0, {})]
        while stack:
            at, way = stack.pop()
            node = tree[at]
            if node["leftChild"] < 0:
                stats = node["impurityStats"]
                value = node["prediction"] if boosted else stats[1] / sum(stats)
                leaves.append((factors[number] * value, [(f, *c) for f, c in sorted(way.items())]))
                continue
            f = node["split"]["featureIndex"]
            cut = node["split"]["leftCategoriesOrThreshold"][0]
            low, high, share = way.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node["leftChild"], (low, min(high, cut))), (node["rightChild"], (max(low, cut), high))):
                part = weight_of[child] / weight_of[at]
                stack.append((child, {**way, f: (*bounds, share * part)}))
    return leaves


def leaf_attribution(x: np.ndarray, leaves: Sequence) -> np.ndarray:
    """Exact path-dependent attribution of every row and feature (Lundberg et al., 2018).

    For a leaf with d conditions, feature i gets value * (o_i - z_i) times the
    Shapley-weighted coefficients of prod_{j != i} (z_j + o_j t), where o says
    whether the row meets a condition and z is its training share.
    """
    out = np.zeros(x.shape)
    for value, way in leaves:
        d = len(way)
        met = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, low, high, _ in way]
        for i, (f, _, _, z_i) in enumerate(way):
            poly = np.zeros((d, len(x)))
            poly[0] = 1.0
            for j, (_, _, _, z_j) in enumerate(way):
                if j == i:
                    continue
                shifted = np.vstack([np.zeros((1, len(x))), poly[:-1]]) * met[j]
                poly = poly * z_j + shifted
            weights = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
            out[:, f] += value * (met[i] - z_i) * (weights[:, None] * poly).sum(axis=0)
    return out


def expected_margin(leaves: Sequence) -> float:
    """The attribution base: mean leaf value under the training shares."""
    return float(sum(value * np.prod([c[3] for c in way]) for value, way in leaves))


def tree_attribution(df: DataFrame, keys: Sequence[str], features: Sequence[str], model) -> DataFrame:
    """Exact attribution per row, long form: (keys, feature, attribution).

    ``model`` is a fitted forest or boosting classifier. Rows are scored batch
    by batch; the attributions of a row add up to its margin minus the base.
    """
    leaves = df.sparkSession.sparkContext.broadcast(tree_leaves(model))
    names, ids = list(features), list(keys)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = leaf_attribution(batch[names].to_numpy(dtype=float), leaves.value)
            yield pd.concat([batch[ids].reset_index(drop=True), pd.DataFrame(values, columns=names)], axis=1)

    known = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in names]).dropna(subset=names)
    wide = known.mapInPandas(explain, known.schema)
    return wide.unpivot(ids, names, "feature", "attribution")


# --- reports ----------------------------------------------------------------------------------

def attribution_summary(attributions: DataFrame) -> DataFrame:
    """Mean absolute and mean signed attribution per feature, strongest first."""
    summary = attributions.groupBy("feature").agg(
        F.avg(F.abs("attribution")).alias("mean_abs_shap"), F.avg("attribution").alias("mean_signed_shap")
    )
    return summary.orderBy(F.desc("mean_abs_shap"), "feature")


def policy_statements(summary: DataFrame, top: int = 5) -> DataFrame:
    """One ranked sentence per strong feature, with its direction."""
    best = summary.orderBy(F.desc("mean_abs_shap"), "feature").limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("mean_abs_shap"), "feature"))
    return best.select(
        rank.alias("rank"), "feature", direction(F.col("mean_signed_shap")).alias("direction"),
        policy_sentence(rank, F.col("feature"), F.col("mean_abs_shap"), F.col("mean_signed_shap")).alias("statement"),
    )
