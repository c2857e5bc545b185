"""Filtered queries, KPIs, filter lists and chart tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard import fixed_values as fv
from panelyard.functions.cleaning import parse_us_date


def in_years(year: Column, first: int | None, last: int | None) -> Column | None:
    """Year range test; a null year is in no range."""
    tests = [t for t in (None if first is None else year >= first, None if last is None else year <= last) if t is not None]
    return reduce(lambda a, b: a & b, tests) if tests else None


def query_panel(
    panel: DataFrame,
    county: str | None = None,
    subcounty: str | None = None,
    year_min: int | None = None,
    year_max: int | None = None,
    county_col: str = "County",
    subcounty_col: str = "SubCounty",
    year_col: str = "Year",
) -> DataFrame:
    """Optional filters, all of which must hold."""
    tests = [
        F.col(county_col) == county if county is not None else None,
        F.col(subcounty_col) == subcounty if subcounty is not None else None,
        in_years(F.col(year_col), year_min, year_max),
    ]
    return reduce(lambda df, t: df if t is None else df.filter(t), tests, panel)


def contains_text(columns: Sequence[str], text: str) -> Column:
    """Case-insensitive literal search in any column; a null column never matches."""
    needle = F.lower(F.lit(text))
    hits = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), needle), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits)


def query_incidents(
    df: DataFrame,
    county: str | None = None,
    subcounty: str | None = None,
    year_min: int | None = None,
    year_max: int | None = None,
    topic_id: int | None = None,
    search: str | None = None,
    domain: str | None = None,
    raw_date: str = "Date_Start",
    search_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Incident filter; rows with an unreadable date drop out of a year filter."""
    out = query_panel(df, county, subcounty, county_col="geo_county", subcounty_col="geo_subcounty")
    years = in_years(F.year(parse_us_date(F.col(raw_date))), year_min, year_max)
    if years is not None:
        out = out.filter(years)
    if topic_id is not None and "topic_id" in df.columns:
        out = out.filter(F.col("topic_id") == topic_id)
    if domain and "conflict_domain" in df.columns:
        out = out.filter(F.col("conflict_domain") == domain)
    if search:
        wanted = [c for c in (search_columns or fv.SEARCH_COLUMNS) if c in df.columns]
        if wanted:
            out = out.filter(contains_text(wanted, search))
    return out


def page(df: DataFrame, order: Sequence[str], limit: int = 500, ceiling: int = 5000) -> DataFrame:
    """The first rows in a fixed order; ``limit`` may not exceed ``ceiling``."""
    if not 0 < limit <= ceiling:
        raise ValueError(f"limit must be between 1 and {ceiling}")
    return df.orderBy(*order).limit(limit)


def panel_summary(panel: DataFrame, persistence: str = "conflict_persistence", extra: Sequence[str] = ()) -> DataFrame:
    """KPI row: months, onset months and means; a mean over only nulls stays null."""
    return panel.agg(
        F.count(F.lit(1)).alias("total_months"),
        F.sum(F.col("conflict_onset").cast("long")).alias("total_onset_months"),
        F.avg(persistence).alias("avg_persistence"),
        *[F.avg(c).alias(f"avg_{c}") for c in extra],
    )


def incident_summary(df: DataFrame, composite: str, severity: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(F.col(composite)).alias("n_composite"),
        F.coalesce(F.avg(severity), F.lit(0.0)).alias("avg_severity"),
    )


def available_filters(
    panel: DataFrame,
    incidents: DataFrame,
    lists: dict[str, tuple[DataFrame, str]],
    year: str = "Year",
    raw_date: str | None = None,
    horizons: Sequence[int] = tuple(fv.HORIZONS_MONTHS),
) -> DataFrame:
    """Every filter option as a (filter, option) row: lists, year range, horizons, unreadable dates.

    Each source is read once, whatever the number of its lists.
    """
    sources: dict[int, DataFrame] = {id(src): src for src, _ in lists.values()}
    rows = []
    for known, src in sources.items():
        own = [F.col(c).cast("string").alias(name) for name, (of, c) in lists.items() if id(of) == known]
        names = [name for name, (of, _) in lists.items() if id(of) == known]
        rows.append(src.select(*own).unpivot([], names, "filter", "option").filter("option is not null").distinct())
    span = panel.agg(F.min(year).cast("string").alias("year_min"), F.max(year).cast("string").alias("year_max"))
    rows.append(span.unpivot([], ["year_min", "year_max"], "filter", "option"))
    if horizons:
        choices = F.explode(F.array(*[F.lit(str(h)) for h in horizons]))
        rows.append(panel.sparkSession.range(1).select(F.lit("horizon_months").alias("filter"), choices.alias("option")))
    if raw_date:
        bad = incidents.agg(
            F.count_if(F.col(raw_date).isNotNull() & parse_us_date(F.col(raw_date)).isNull()).cast("string").alias("option")
        )
        rows.append(bad.select(F.lit("n_unparseable_dates").alias("filter"), "option"))
    return reduce(DataFrame.unionByName, rows)


def counts_by_year(df: DataFrame, date: Column, severity: str) -> DataFrame:
    """Records and mean severity (0 if none known) per year; rows without a date are left out."""
    return (
        df.withColumn("year", F.year(date))
        .filter(F.col("year").isNotNull())
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.avg(severity), F.lit(0.0)).alias("avg_severity"))
    )


def counts_by_month(df: DataFrame, date: Column) -> DataFrame:
    """Records per calendar month, always twelve rows."""
    spark: SparkSession = df.sparkSession
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    counts = df.groupBy(F.month(date).alias("month")).agg(F.count(F.lit(1)).alias("count"))
    label = F.date_format(F.make_date(F.lit(2000), F.col("month"), F.lit(1)), "MMM")
    return months.join(counts, "month", "left").select("month", label.alias("month_label"), F.coalesce("count", F.lit(0)).alias("count"))


def live_topic_counts(df: DataFrame, topics: DataFrame, topic: str = "topic_id") -> DataFrame:
    """Each known topic with its number of records, 0 when it has none."""
    counts = df.groupBy(topic).agg(F.count(F.lit(1)).alias("n_records"))
    return topics.join(counts, topic, "left").fillna({"n_records": 0})


def live_topics(topics: DataFrame, df: DataFrame, topic: str = "topic_id") -> DataFrame:
    """Topics that still have at least one record."""
    return topics.join(df.select(topic).distinct(), topic, "left_semi")


def chart_pivot(df: DataFrame, rows: Column, row_name: str, columns: str, values: Sequence[str], cell: str) -> DataFrame:
    """One line per row value and one column per series; the first known cell in value order."""
    return df.groupBy(rows.alias(row_name)).pivot(columns, list(values)).agg(F.min(cell))


def extent(df: DataFrame, lon: str, lat: str) -> DataFrame:
    return df.agg(
        F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"), F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat")
    )


def selection_extent(
    areas: DataFrame, points: DataFrame, lon: str, lat: str,
    area: str | None = None, county: str | None = None, filtered: Column | None = None,
    area_col: str = "area", county_col: str = "county",
) -> DataFrame:
    """Extent of the chosen area, else county, else filtered points, else everything."""
    if area is not None:
        return extent(areas.filter(F.col(area_col) == area), lon, lat)
    if county is not None:
        return extent(areas.filter(F.col(county_col) == county), lon, lat)
    return extent(points.filter(filtered), lon, lat) if filtered is not None else extent(areas, lon, lat)


def coverage_report(tables: dict[str, DataFrame], by: str, date: str) -> DataFrame:
    """Rows and latest date per output table and ``by`` value (for example the horizon)."""
    parts = [
        t.groupBy(F.col(by).cast("string").alias(by)).agg(F.count(F.lit(1)).alias("n"), F.max(date).cast("string").alias("latest"))
        .withColumn("step", F.lit(name))
        for name, t in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
