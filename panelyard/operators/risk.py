"""Latest complete features, relative risk classes and the risk layer over all areas."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators.metrics import tertiles


def latest_complete(panel: DataFrame, keys: Sequence[str], features: Sequence[str], date: str = "panel_date") -> DataFrame:
    """The last row per area in which every feature is known."""
    others = [c for c in panel.columns if c not in keys]
    last = panel.dropna(subset=list(features)).groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.col(date)).alias("_row")
    )
    return last.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in panel.columns])


def risk_layer(
    boundaries: DataFrame,
    panel: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    date: str = "panel_date",
) -> DataFrame:
    """Latest features -> risk_probability -> relative class -> every polygon, null where nothing is known.

    ``score`` adds ``risk_probability`` to the latest rows.
    """
    latest = latest_complete(panel, keys, features, date)
    classed = tertiles(score(latest), "risk_probability")
    facts = classed.select(*keys, F.col(date).alias("target_month"), "risk_probability", "risk_category")
    return boundaries.join(facts, list(keys), "left")


def top_risk(layer: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    return layer.filter(F.col("risk_probability").isNotNull()).orderBy(F.desc("risk_probability"), *keys).limit(n)


def with_geometry(boundaries: DataFrame, summary: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Areas with geometry and a known value."""
    return boundaries.join(summary, list(keys), "inner").filter(F.col(value).isNotNull())
