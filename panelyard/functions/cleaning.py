"""Dates, counts, composite flags, severity and encoding repair for raw incidents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard import fixed_values as fv


def known_number(c: Column) -> Column:
    """A double, with NaN turned into null."""
    return F.when(~F.isnan(c), c)


def strip(c: Column) -> Column:
    """Without any white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def to_number(c: Column) -> Column:
    return known_number(c.try_cast("double"))


def parse_us_date(c: Column) -> Column:
    """``M/D/YYYY`` text to a date; anything else becomes null."""
    return F.to_date(F.try_to_timestamp(F.trim(c), F.lit("M/d/yyyy")))


def parse_dates(df: DataFrame, start: str = "Date_Start", end: str = "Date_End") -> DataFrame:
    """Parsed start and end, the length in days, and the flag for 1 January dates."""
    begin, finish = parse_us_date(F.col(start)), parse_us_date(F.col(end))
    return df.withColumns(
        {
            f"{start}_parsed": begin,
            f"{end}_parsed": finish,
            "duration_days": F.datediff(finish, begin),
            "date_precision_suspect": suspect_date(begin),
        }
    )


def suspect_date(c: Column) -> Column:
    return F.coalesce((F.month(c) == 1) & (F.dayofmonth(c) == 1), F.lit(False))


def failed_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many non-null values of each raw date column could not be parsed."""
    bad = [
        F.count_if(F.col(c).isNotNull() & parse_us_date(F.col(c)).isNull()).alias(c) for c in columns
    ]
    return df.agg(*bad).unpivot([], columns, "column", "failed")


def without_suspect_dates(df: DataFrame, flag: str = "date_precision_suspect", exclude: bool = False) -> DataFrame:
    """Drop records with a suspect date, only when asked to."""
    return df.filter(~F.coalesce(F.col(flag), F.lit(False))) if exclude else df


def count_columns(c: Column, missing_is_unknown: bool = False) -> dict[str, Column]:
    """Number, lower-bound flag and unknown flag of a text such as ``69+``."""
    text = strip(c.cast("string"))
    unknown = F.coalesce(F.lower(text) == "unknown", F.lit(missing_is_unknown))
    return {
        "numeric": F.when(~unknown, to_number(F.regexp_replace(text, r"\++$", ""))),
        "is_lower_bound": F.coalesce(F.endswith(text, F.lit("+")), F.lit(False)) & ~unknown,
        "is_unknown": unknown,
    }


def clean_counts(
    df: DataFrame,
    columns: tuple[str, ...] = ("Casualties_Reported", "Displaced_Persons"),
    missing_is_unknown: bool = False,
) -> DataFrame:
    new = {
        f"{name}_{part}": value
        for name in columns
        for part, value in count_columns(F.col(name), missing_is_unknown).items()
    }
    return df.withColumns(new)


def flag_composite(
    df: DataFrame,
    notes: str = "Notes",
    duration: str = "duration_days",
    longer_than: int = fv.LONG_DURATION_DAYS,
    words: str = fv.CHRONIC_WORDS,
) -> DataFrame:
    long_running = F.coalesce(F.col(duration) > longer_than, F.lit(False))
    mentions = F.coalesce(F.col(notes).rlike(f"(?i){words}"), F.lit(False))
    return df.withColumns(
        {
            "is_long_duration": long_running,
            "notes_mentions_chronic": mentions,
            "Is_Composite": long_running | mentions,
        }
    )


def severity(casualties: str = "Casualties_Reported", displaced: str = "Displaced_Persons") -> Column:
    """ln(1+c) + ln(1+d)/2; null only when both counts are flagged unknown."""
    score = F.log1p(F.coalesce(F.col(f"{casualties}_numeric"), F.lit(0.0))) + 0.5 * F.log1p(
        F.coalesce(F.col(f"{displaced}_numeric"), F.lit(0.0))
    )
    return F.when(~(F.col(f"{casualties}_is_unknown") & F.col(f"{displaced}_is_unknown")), score)


def clean_incidents(df: DataFrame) -> DataFrame:
    """Dates, counts, composite flag and severity in one projection chain."""
    dated = clean_counts(parse_dates(repair_text(df)))
    return flag_composite(dated).withColumn("severity_score", severity())


def _undo_double_encoding(text: str) -> str:
    while True:  # each round shortens the text
        for wrong in ("cp1252", "latin-1"):
            try:
                better = text.encode(wrong).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            break
        else:
            return text
        if better == text:
            return text
        text = better


@F.pandas_udf(T.StringType())
def undo_double_encoding(texts: pd.Series) -> pd.Series:
    """UTF-8 text once read as a western single-byte encoding, put right again."""
    return texts.map(_undo_double_encoding, na_action="ignore")


def repair_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Repair the text columns that exist; plain ASCII never leaves the JVM."""
    chosen = [c for c in (columns or fv.MOJIBAKE_COLUMNS) if c in df.columns]
    fixed = {
        c: F.when(F.col(c).rlike(r"[^\x00-\x7F]"), undo_double_encoding(F.col(c))).otherwise(F.col(c))
        for c in chosen
    }
    return df.withColumns(fixed) if fixed else df


def repaired_count(before: DataFrame, columns: list[str]) -> DataFrame:
    """How many values of each column the repair changes."""
    fixed = repair_text(before.select(*columns, *[F.col(c).alias(f"raw_{c}") for c in columns]), columns)
    changed = [F.count_if(~F.col(c).eqNullSafe(F.col(f"raw_{c}"))).alias(c) for c in columns]
    return fixed.agg(*changed).unpivot([], columns, "column", "changed")
