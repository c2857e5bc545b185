"""Imports every query module, which fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.plans import (  # noqa: F401
    explore_queries,
    model_queries,
    panel_queries,
    record_queries,
    serve_queries,
    spatial_queries,
    text_queries,
    topic_queries,
)
from panelyard.plans.inputs import panel
from panelyard.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel KPIs per county over the decayed persistence panel."""
    return (
        panel(spark, sf_dir)
        .groupBy("county")
        .agg(
            F.count(F.lit(1)).alias("total_months"),
            F.sum(F.col("conflict_onset").cast("int")).alias("total_onset_months"),
            F.avg("conflict_persistence").alias("avg_persistence"),
            F.avg("conflict_severity_weighted").alias("avg_severity_weighted"),
        )
    )
