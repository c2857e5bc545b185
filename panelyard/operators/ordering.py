"""Running totals, row numbers and exact quantiles without a one-task window.

A window without partition keys (or with one hot key) sorts everything in one
task. Here the ordering column is first cut at approximate quantiles of the
whole input, so that no (group, slice) holds more than about 1/parts of the
rows. Totals per slice are summed up over the few slices, and the exact order
is only needed inside a slice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.session import parallelism, stored


def _as_double(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(column)).cast("double")
    return F.col(column).cast("double")


def sliced(df: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """Add ``_slice``, a monotone function of ``column`` with balanced sizes.

    The cut points are literals in the plan, so a recomputed task gets the
    same slices as the first run. Nulls come last.
    """
    parts = parts or parallelism(df.sparkSession)
    if isinstance(df.schema[column].dataType, (T.StringType, T.BinaryType)):
        return _sliced_text(df, column, parts)
    keyed = df.withColumn("_pos", _as_double(df, column))
    probs = [i / parts for i in range(1, parts)]
    cuts = keyed.select("_pos").approxQuantile("_pos", probs, 0.5 / parts)
    inner = sorted({c for c in cuts if c is not None and math.isfinite(c)})
    if not inner:
        return keyed.withColumn("_slice", F.lit(0)).drop("_pos")
    splits = [-math.inf, *inner, math.inf]
    cut = Bucketizer(splits=splits, inputCol="_pos", outputCol="_cut", handleInvalid="keep")
    return cut.transform(keyed).withColumn("_slice", F.coalesce(F.col("_cut").cast("int"), F.lit(len(splits)))).drop("_pos", "_cut")


def _sliced_text(df: DataFrame, column: str, parts: int, per_part: int = 50) -> DataFrame:
    """Slices of a text column: cut points come from an even sample of about ``per_part`` values per slice; nulls are last."""
    known = df.select(column).filter(F.col(column).isNotNull())
    rows = known.count()
    share = min(1.0, parts * per_part / max(1, rows))
    found = sorted(r[0] for r in known.sample(share, seed=11).collect()) if rows else []
    cuts = sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []
    if not cuts:
        return df.withColumn("_slice", F.when(F.col(column).isNull(), 1).otherwise(0))
    below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(column)))
    return df.withColumn("_slice", F.when(F.col(column).isNull(), len(cuts) + 1).otherwise(below))


def attach(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-group values; without groups the one row comes in as a scalar subquery."""
    if by:
        return df.join(small, list(by), "left")
    one = small.select(F.struct(*small.columns).alias("_one")).scalar()
    return df.withColumn("_one", one).select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in small.columns])


def running_totals(
    df: DataFrame,
    order: str,
    sums: dict[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """One row per (by, distinct ``order`` value) with sums and running sums.

    For every name in ``sums`` the result has the sum at that value (``name``),
    the running sum up to and including it (``cum_name``) and the group total
    (``all_name``). Ties share a row, so the running sums are tie-safe.
    """
    by = list(by)
    known = df.filter(F.col(order).isNotNull())
    grouped = sliced(known, order, parts).groupBy(*by, "_slice", order).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    per_slice = grouped.groupBy(*by, "_slice").agg(*[F.sum(n).alias(f"_s_{n}") for n in sums])
    slice_key = F.col("_slice").desc() if descending else F.col("_slice").asc()
    before = Window.partitionBy(*by).orderBy(slice_key).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_slice.select(
        *by,
        "_slice",
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(whole).alias(f"all_{n}") for n in sums],
    )
    order_key = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*by, "_slice").orderBy(order_key).rowsBetween(Window.unboundedPreceding, 0)
    joined = grouped.join(offsets, [*by, "_slice"])
    return joined.select(
        *by,
        order,
        *sums,
        *[(F.col(f"_before_{n}") + F.sum(n).over(inside)).alias(f"cum_{n}") for n in sums],
        *[f"all_{n}" for n in sums],
    )


def numbered(df: DataFrame, order: str, out: str, by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Add a dense row number (from 1) by ``order``, which must be unique per group."""
    by = list(by)
    cut = sliced(df, order, parts)
    per_slice = cut.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(F.col(order).asc_nulls_last())
    null_safe = None
    for c in [*by, "_slice"]:
        test = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        null_safe = test if null_safe is None else null_safe & test
    ranked = cut.withColumn("_in", F.row_number().over(inside)).alias("l")
    return ranked.join(offsets.alias("r"), null_safe).select(
        *[F.col(f"l.{c}").alias(c) for c in df.columns],
        (F.col("r._before") + F.col("l._in")).cast("long").alias(out),
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), out: str = "quantiles"
) -> DataFrame:
    """Linear-interpolated quantiles as an array column, one row per group."""
    ranked = running_totals(df, value, {"n": F.lit(1)}, by)
    first = F.col("cum_n") - F.col("n")
    picks = []
    for i, p in enumerate(probs):
        at = (F.col("all_n") - 1) * F.lit(float(p))
        for tag, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (first <= pos) & (pos < F.col("cum_n"))
            picks.append(F.max(F.when(hit, F.col(value))).cast("double").alias(f"_{tag}{i}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_w{i}"))
    found = ranked.groupBy(*by).agg(*picks)
    points = [
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}") for i in range(len(probs))
    ]
    return found.select(*by, F.array(*points).alias(out))


def ranked_by(df: DataFrame, key: str, out: str) -> DataFrame:
    """Add a number from 1 by a sortable column of any type: rows are ranged by it, sorted in their range, and counted.

    Rows that agree in ``key`` take neighbouring numbers in no given order.
    """
    part = stored(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ranged")
    rows = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per partition
    earlier = F.broadcast(rows.select("_part", before.alias("_before")))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return part.withColumn("_in", within).join(earlier, "_part").select(*df.columns, (F.col("_before") + F.col("_in")).alias(out))
