"""Summaries of the panel and of incident records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.stats import chi2_pvalue, t_pvalue
from panelyard.operators.ordering import attach, exact_quantiles
from panelyard.session import fits


def area_summary(
    panel: DataFrame, keys: Sequence[str], means: Sequence[str], onset: str = "conflict_onset"
) -> DataFrame:
    """One row per area: onset months summed, everything else averaged."""
    return panel.groupBy(*keys).agg(
        F.sum(F.col(onset).cast("long")).alias("total_onset_months"), *[F.avg(c).alias(c) for c in means]
    )


def yearly_trend(
    panel: DataFrame,
    value: Column,
    out: str,
    by: Sequence[str] = (),
    year: str = "Year",
    complete_years_only: bool = False,
) -> DataFrame:
    """Sum per year (and group) plus the number of distinct months behind it."""
    yearly = panel.groupBy(*by, year).agg(F.sum(value).alias(out), F.countDistinct("Month").alias("n_months"))
    return yearly.filter(F.col("n_months") == 12) if complete_years_only else yearly


def linear_trend(yearly: DataFrame, value: str, year: str = "Year") -> DataFrame:
    """Slope, r squared and two-sided p-value of value over year, as one row."""
    fit = yearly.agg(
        F.regr_slope(value, year).alias("trend_slope"),
        F.regr_r2(value, year).alias("trend_r_squared"),
        F.regr_count(value, year).alias("n"),
        F.signum(F.regr_slope(value, year)).alias("_sign"),
    )
    r2, free = F.col("trend_r_squared"), F.col("n") - 2
    t = F.col("_sign") * F.sqrt(r2 * free / F.nullif(1 - r2, F.lit(0.0)))
    exact_line = (r2 >= 1) & (free > 0)
    p = F.when(exact_line, F.lit(0.0)).otherwise(F.nanvl(t_pvalue(t, free.cast("double")), F.lit(None)))
    return fit.withColumn("trend_pvalue", p).select("trend_slope", "trend_r_squared", "trend_pvalue", "n")


def seasonal_pattern(panel: DataFrame, value: Column, name: str, month: str = "Month") -> DataFrame:
    """Total, mean and sample deviation per calendar month over all years."""
    return panel.groupBy(month).agg(
        F.sum(value).alias(f"{name}_total"), F.avg(value).alias(f"{name}_mean"), F.stddev_samp(value).alias(f"{name}_std")
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows and share per distinct value, most frequent first."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all_n"))
    return attach(counts, total, []).select(
        *columns, "n", (F.col("n") / F.col("all_n")).alias("share")
    ).orderBy(F.desc("n"), *columns)


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence | None = None, max_columns: int = 1000) -> DataFrame:
    """Counts with one column per value of ``columns``, 0 for empty cells."""
    if values is None:
        seen = df.select(columns).filter(F.col(columns).isNotNull()).distinct()
        if not fits(seen, max_columns):
            raise ValueError(f"more than {max_columns} values in {columns}; name the wanted ones")
        values = sorted(r[0] for r in seen.collect())
    return df.groupBy(rows).pivot(columns, list(values)).count().fillna(0)


def chi_square(df: DataFrame, rows: str, columns: str, correction: bool = True) -> DataFrame:
    """Independence test: statistic, degrees of freedom, p-value, smallest expected count.

    Empty when either side has fewer than two values. A 2x2 table gets the
    continuity correction by default, as in the usual statistics libraries.
    """
    cells = df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows, columns).agg(
        F.count(F.lit(1)).alias("o")
    )
    row_sums = cells.groupBy(rows).agg(F.sum("o").alias("r"))
    col_sums = cells.groupBy(columns).agg(F.sum("o").alias("c"))
    filled = cells.join(row_sums, rows).join(col_sums, columns)
    totals = row_sums.agg(
        F.sum("r").cast("double").alias("n"), F.count("r").alias("n_rows"), F.min("r").alias("r_min"),
        F.product(F.col("r").cast("double")).alias("r_prod"),
    )
    cols = col_sums.agg(
        F.count("c").alias("n_cols"), F.min("c").alias("c_min"), F.product(F.col("c").cast("double")).alias("c_prod")
    )
    # sum over non-empty cells of o^2/e - n  equals  sum over all cells of (o-e)^2/e
    core = filled.agg(
        F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("core"),
    )
    both = attach(attach(core, totals, []), cols, [])
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    plain = F.greatest(F.col("n") * (F.col("core") - 1), F.lit(0.0))
    out = both.withColumns({"dof": dof, "chi2": plain, "min_expected": F.col("r_min") * F.col("c_min") / F.col("n")})
    if correction:
        # 2x2: chi2 = n * det^2 / (r1 r2 c1 c2), so |det| follows from the plain statistic
        scale = F.col("r_prod") * F.col("c_prod")
        det = F.sqrt(F.col("chi2") * scale / F.col("n"))
        less = F.greatest(det - F.col("n") / 2, F.lit(0.0))
        out = out.withColumn(
            "chi2", F.when(F.col("dof") == 1, F.col("n") * less * less / scale).otherwise(F.col("chi2"))
        )
    return out.filter((F.col("n_rows") > 1) & (F.col("n_cols") > 1)).select(
        "chi2",
        chi2_pvalue(F.col("chi2"), F.col("dof").cast("double")).alias("p_value"),
        "dof",
        "min_expected",
        (F.col("min_expected") < 5).alias("low_expected"),
    )


def group_severity(df: DataFrame, group: str, value: str) -> DataFrame:
    """Non-null count, mean, exact median and sample deviation per group."""
    known = df.filter(F.col(group).isNotNull())
    basic = known.groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    middle = exact_quantiles(known, value, [0.5], [group], "_q")
    return basic.join(middle, group, "left").select(group, "n", "mean", F.col("_q")[0].alias("median"), "std")


def agreement_rates(df: DataFrame, period: str, old: str, new: str, outlier: int = -1) -> DataFrame:
    """Per period: rows, share with equal old and new label, share of new outliers."""
    return df.groupBy(period).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(old).eqNullSafe(F.col(new)).cast("double")).alias("agreement"),
        F.avg((F.col(new) == outlier).cast("double")).alias("outlier_rate"),
    )
