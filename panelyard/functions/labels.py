"""Small label and weight rules for maps and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hotspot_label(z: Column, p: Column) -> Column:
    """Hotspot or coldspot with the confidence the p-value allows."""
    kind = F.when(z > 0, "Hotspot").otherwise("Coldspot")
    level = F.when(p < 0.01, "99%").when(p < 0.05, "95%").otherwise("90%")
    return F.when(p > 0.10, F.lit("Not significant")).when(
        p.isNotNull(), F.concat(kind, F.lit(" ("), level, F.lit(" confidence)"))
    )


def map_risk_label(c: Column) -> Column:
    return (
        F.when(c.isin("Low", "Lower"), "Low")
        .when(c == "Medium", "Medium")
        .when(c.isin("High", "Higher"), "High")
        .otherwise("No data")
    )


def heat_weight(severity: Column) -> Column:
    return F.when(severity.isNotNull(), F.least(severity, F.lit(10.0)) / 10).otherwise(F.lit(0.4))


def direction(signed: Column) -> Column:
    return (
        F.when(signed > 0, "HIGHER values of this feature INCREASE predicted risk")
        .when(signed < 0, "HIGHER values of this feature DECREASE predicted risk")
        .otherwise("direction is mixed/ambiguous across records")
    )


def policy_sentence(rank: Column, feature: Column, strength: Column, signed: Column) -> Column:
    return F.format_string("%d. %s: mean |SHAP| = %.4f -- %s", rank, feature, strength, direction(signed))
