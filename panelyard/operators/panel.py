"""The area-by-month panel: grid, static and monthly features, decayed event features.

Decay by days is additive, so events are first summed per (area, month) with
their weight at the first month start on or after the event. The decayed sum
at month t is then  2^(-t/h) * running_sum(S(m) * 2^(m/h)),  one window over
the few month rows of an area. Event volume only meets a map-side combine;
there is no join of events with later months.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard import fixed_values as fv

LN2 = 0.6931471805599453


#: Half-lives after which exponents start anew.
SPAN = 500


def decay_weight(days: Column, half_life: Column) -> Column:
    """exp(-ln2 * days / half-life), days never below zero."""
    return F.exp(-F.lit(LN2) * F.greatest(days, F.lit(0)) / half_life)


def half_life(composite: Column, days: float, multiplier: float = fv.COMPOSITE_MULTIPLIER) -> Column:
    return F.when(composite, F.lit(float(days) * multiplier)).otherwise(F.lit(float(days)))


def build_grid(areas: DataFrame, start: str, end: str, date: str = "panel_date") -> DataFrame:
    """Every distinct area with every month start in [start, end]."""
    first = F.lit(start).cast("date")
    month_one = F.when(F.dayofmonth(first) == 1, first).otherwise(F.add_months(F.trunc(first, "month"), 1))
    months = F.sequence(month_one, F.lit(end).cast("date"), F.expr("interval 1 month"))
    return areas.distinct().withColumn(date, F.explode(months)).withColumns(
        {"Year": F.year(date), "Month": F.month(date)}
    )


def add_static_first(grid: DataFrame, dim: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Left join the first row per key of an attribute table, rows with a null ``order`` last."""
    place = F.struct(F.col(order).isNull(), F.col(order))
    first = dim.groupBy(key).agg(F.min_by(F.struct(*columns), place).alias("_first"))
    return grid.join(first, key, "left").select(*grid.columns, *[F.col(f"_first.{c}").alias(c) for c in columns])


def add_static_sum(grid: DataFrame, rows: DataFrame, key: str, row_key: str, value: str, out: str) -> DataFrame:
    """Sum per area, null keys dropped, 0 where an area has no row."""
    total = rows.filter(F.col(row_key).isNotNull()).groupBy(F.col(row_key).alias(key)).agg(F.sum(value).alias(out))
    return grid.join(total, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


def add_static_count(grid: DataFrame, rows: DataFrame, key: str, row_key: str, out: str) -> DataFrame:
    """Row count per area, null keys dropped, 0 where an area has no row."""
    total = rows.filter(F.col(row_key).isNotNull()).groupBy(F.col(row_key).alias(key)).agg(
        F.count(F.lit(1)).alias(out)
    )
    return grid.join(total, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def add_monthly_means(
    grid: DataFrame, rows: DataFrame, key: str, row_key: str, year: Column, month: Column, values: dict[str, Column]
) -> DataFrame:
    """Left join monthly means per area on (area, Year, Month)."""
    means = (
        rows.filter(F.col(row_key).isNotNull())
        .groupBy(F.col(row_key).alias(key), year.cast("int").alias("Year"), month.cast("int").alias("Month"))
        .agg(*[F.avg(c).alias(n) for n, c in values.items()])
    )
    return grid.join(means, [key, "Year", "Month"], "left")


def first_month_from(day: Column) -> Column:
    """The first month start that is not before ``day``."""
    return F.when(F.dayofmonth(day) == 1, day).otherwise(F.add_months(F.trunc(day, "month"), 1))


def _decayed(
    grid: DataFrame,
    events: DataFrame,
    keys: list[str],
    start: str,
    composite: str,
    measures: dict[str, Column],
    days: float | Sequence[float],
    multiplier: float,
    date: str,
) -> DataFrame:
    """Decayed running sums of ``measures`` for every row of ``grid``, 0 before the first event.

    Months with events outside the grid take part in the running sum and are
    dropped afterwards. Exponents count from the first asked month of the key
    and start anew after every ``SPAN`` half-lives; the span before is carried
    over and what lies further back is below 2^-500 of its weight. So neither
    a long grid nor one absurd date leaves the range of a double.
    """
    begin = F.to_date(start)
    known = events.filter(F.col(start).isNotNull()).withColumns(
        {"_slow": F.coalesce(F.col(composite), F.lit(False)), "_at": first_month_from(begin)}
    )
    every = list(days) if isinstance(days, (list, tuple)) else [days]
    # the column suffix of each half-life; a single one has none
    suffix = {float(x): f"_{float(x)}" if len(every) > 1 else "" for x in every}
    lives = {f"{tag}{suffix[x]}": x * by for x in suffix for tag, by in (("quick", 1.0), ("slow", float(multiplier)))}
    weight = {tag: decay_weight(F.datediff("_at", begin), F.lit(life)) for tag, life in lives.items()}
    per_month = known.groupBy(*keys, F.col("_at").alias(date)).agg(
        *[
            F.sum(F.when(F.col("_slow") == F.lit(tag.startswith("slow")), weight[tag] * c)).alias(f"_{n}_{tag}")
            for n, c in measures.items() for tag in lives
        ]
    )
    by_key = Window.partitionBy(*keys)
    joined = grid.withColumn("_asked", F.lit(True)).join(per_month, [*keys, date], "full_outer")
    timed = joined.withColumn("_offset", F.datediff(date, F.min(F.when(F.col("_asked"), F.col(date))).over(by_key)))
    for tag, life in lives.items():
        halvings = F.col("_offset") / F.lit(life)
        span = F.floor(halvings / SPAN)
        timed = timed.withColumn(f"_span_{tag}", span).withColumn(f"_up_{tag}", F.exp(F.lit(LN2) * (halvings - span * SPAN)))
    sums = {}
    for n in measures:
        parts = []
        for tag in lives:
            by_span = Window.partitionBy(*keys, f"`_span_{tag}`").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
            span_before = by_key.orderBy(f"`_span_{tag}`").rangeBetween(-1, -1)
            scaled = F.coalesce(F.col(f"`_{n}_{tag}`"), F.lit(0.0)) * F.col(f"`_up_{tag}`")
            carried = F.coalesce(F.sum(scaled).over(span_before), F.lit(0.0)) * F.lit(2.0**-SPAN)
            parts.append((F.sum(scaled).over(by_span) + carried) / F.col(f"`_up_{tag}`"))
        for k, end in enumerate(suffix.values()):
            sums[f"{n}{end}"] = parts[2 * k] + parts[2 * k + 1]
    summed = timed.select("_asked", *grid.columns, *[c.alias(n) for n, c in sums.items()])
    return summed.filter("_asked").drop("_asked")


def add_conflict_features(
    grid: DataFrame,
    events: DataFrame,
    area: str = "SubCounty",
    start: str = "Date_Start_parsed",
    severity: str = "severity_score",
    composite: str = "Is_Composite",
    days: float = fv.HALF_LIFE_DAYS,
    multiplier: float = fv.COMPOSITE_MULTIPLIER,
    date: str = "panel_date",
    onset_events: DataFrame | None = None,
) -> DataFrame:
    """Onset flag, decayed persistence and severity-weighted persistence per grid row.

    Only events that start on or before the month start count, so later events
    never change an earlier row. The onset flag looks at the whole month, and
    at ``onset_events`` when those differ from the decayed ones.
    """
    measures = {
        "conflict_persistence": F.lit(1.0),
        "conflict_severity_weighted": F.coalesce(F.col(severity), F.lit(0.0)),
    }
    decayed = _decayed(grid, events, [area], start, composite, measures, days, multiplier, date)
    return add_onset(decayed, events if onset_events is None else onset_events, area, start, date)


def add_onset(grid: DataFrame, events: DataFrame, area: str, start: str, date: str = "panel_date") -> DataFrame:
    begun = (
        events.filter(F.col(start).isNotNull())
        .groupBy(F.col(area), F.trunc(F.to_date(start), "month").alias(date))
        .agg(F.lit(True).alias("conflict_onset"))
    )
    return grid.join(begun, [area, date], "left").withColumn(
        "conflict_onset", F.coalesce("conflict_onset", F.lit(False))
    )


def half_life_sensitivity(
    grid: DataFrame,
    events: DataFrame,
    key: str,
    start: str,
    composite: str,
    measure: Column,
    half_lives: Sequence[float] = tuple(fv.HALF_LIVES_DAYS),
    multiplier: float = fv.COMPOSITE_MULTIPLIER,
    date: str = "panel_date",
) -> DataFrame:
    """The decayed sum per key and month for several half-lives, stacked."""
    wide = _decayed(grid, events, [key], start, composite, {"persistence": measure}, list(half_lives), multiplier, date)
    if len(half_lives) == 1:
        return wide.withColumn("half_life_days", F.lit(int(half_lives[0])))
    each = F.array(*[F.struct(F.col(f"`persistence_{float(d)}`").alias("persistence"), F.lit(int(d)).alias("half_life_days")) for d in half_lives])
    return wide.select(*grid.columns, F.explode(each).alias("_e")).select(*grid.columns, "_e.persistence", "_e.half_life_days")


def decayed_sum_by_pairs(
    grid: DataFrame,
    events: DataFrame,
    area: str,
    start: str,
    composite: str,
    days: float = fv.HALF_LIFE_DAYS,
    multiplier: float = fv.COMPOSITE_MULTIPLIER,
    date: str = "panel_date",
) -> DataFrame:
    """The defining range join (events with start <= month); a check for small inputs."""
    past = grid.select(area, date).join(
        events.select(area, F.to_date(start).alias("_begin"), F.coalesce(F.col(composite), F.lit(False)).alias("_slow")),
        area,
    ).filter(F.col("_begin") <= F.col(date))
    weight = decay_weight(F.datediff(date, "_begin"), half_life(F.col("_slow"), days, multiplier))
    total = past.groupBy(area, date).agg(F.sum(weight).alias("conflict_persistence"))
    return grid.join(total, [area, date], "left").fillna({"conflict_persistence": 0.0})


def add_text_features(
    grid: DataFrame,
    events: DataFrame,
    area: str = "SubCounty",
    start: str = "Date_Start_parsed",
    composite: str = "Is_Composite",
    tone: str = "sentiment_score",
    topic: str = "topic_id",
    days: float = fv.HALF_LIFE_DAYS,
    multiplier: float = fv.COMPOSITE_MULTIPLIER,
    date: str = "panel_date",
    skip_null_tone: bool = False,
) -> DataFrame:
    """Decayed mean tone, dominant topic and topic diversity; null before the first event.

    A null tone counts as 0 with its full weight unless ``skip_null_tone``; a
    null topic is -1; equal topic weights are settled by the smaller topic.
    """
    weight_of = F.col(tone).isNotNull().cast("double") if skip_null_tone else F.lit(1.0)
    tones = _decayed(
        grid, events, [area], start, composite,
        {"_tone": F.coalesce(F.col(tone), F.lit(0.0)), "_weight": weight_of}, days, multiplier, date,
    )
    with_topic = events.withColumn("_topic", F.coalesce(F.col(topic).cast("int"), F.lit(-1)))
    topics_seen = with_topic.select(area, "_topic").distinct()
    cells = grid.select(area, date).join(topics_seen, area)
    weights = _decayed(
        cells, with_topic, [area, "_topic"], start, composite, {"_w": F.lit(1.0)}, days, multiplier, date
    ).filter(F.col("_w") > 0)
    by_cell = Window.partitionBy(area, date)
    share = weights.withColumn("_p", F.col("_w") / F.sum("_w").over(by_cell))
    mix = share.groupBy(area, date).agg(
        F.min_by("_topic", F.struct(-F.col("_w"), F.col("_topic"))).alias("dominant_topic_id"),
        F.greatest(F.lit(0.0), -F.sum(F.col("_p") * F.log(F.col("_p") + F.lit(1e-12)))).alias("topic_diversity"),
    )
    told = tones.withColumn("decayed_sentiment", F.when(F.col("_weight") > 0, F.col("_tone") / F.col("_weight")))
    return told.drop("_tone", "_weight").join(mix, [area, date], "left")


def completeness(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent of non-null values per column."""
    share = [(F.avg(F.col(c).isNotNull().cast("double")) * 100).alias(c) for c in columns]
    return panel.agg(*share).unpivot([], list(columns), "column_name", "percent_complete")


def peak_area(panel: DataFrame, area: str, value: str) -> DataFrame:
    """The area with the highest maximum of ``value`` (ties: first name)."""
    peaks = panel.groupBy(area).agg(F.max(value).alias("peak"))
    return peaks.agg(
        F.min_by(area, F.struct(-F.col("peak"), F.col(area))).alias(area), F.max("peak").alias("peak")
    )
