"""Incremental intake and monthly counts as structured streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard import fixed_values as fv
from panelyard.functions import drafts as D
from panelyard.session import scratch_path


def candidate_stream(
    items: DataFrame,
    seen_at: str,
    keywords: Sequence[str] = tuple(fv.SCOPE_KEYWORDS),
    places: Sequence[str] = tuple(fv.TARGET_COUNTIES),
    remember: str = "30 days",
) -> DataFrame:
    """Each URL once (its first item within ``remember``), kept when in scope or listed by hand."""
    once = items.filter(F.coalesce(F.col("url"), F.lit("")) != "").withWatermark(seen_at, remember).dropDuplicatesWithinWatermark(["url"])
    tests = D.scope(F.col("title"), F.col("snippet"), keywords, places)
    manual = F.coalesce(F.col("discovered_via") == "manual", F.lit(False))
    checked = once.withColumns(tests).withColumn("manual_override", manual)
    return checked.filter(F.col("manual_override") | F.col("in_scope")).drop("in_scope")


def period_counts(events: DataFrame, area: str, at: str, period: str = "month", late: str = "40 days", days: str = "1 day") -> DataFrame:
    """Events and distinct-day flags per area and calendar period; late rows count until the watermark passes.

    ``period`` 'month' keys by calendar month, anything else is a tumbling
    window of ``days``. Both run in append mode: a period is told once, when
    the watermark has passed it, and then leaves the state. The watermark of
    months is kept on their first day.
    """
    if period == "month":
        keyed = events.withColumn("period_start", F.date_trunc("month", at)).withWatermark("period_start", late)
        return keyed.groupBy(F.col(area), "period_start").agg(F.count(F.lit(1)).alias("n_events"))
    counts = events.withWatermark(at, late).groupBy(F.col(area), F.window(at, days).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return counts.select(area, F.col("w.start").alias("period_start"), "n_events")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and read the result table back.

    Append results go to a parquet folder; complete results replace the folder
    of their batch. Both and the stream's own checkpoint live in the shared
    folder.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
    else:
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
