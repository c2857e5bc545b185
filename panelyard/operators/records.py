"""Record-level duplicates, id repair, keep-first, enrichment joins and split writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators.ordering import numbered


def duplicate_report(df: DataFrame, id_col: str) -> DataFrame:
    """Rows in full-row duplicates, rows sharing an id, and how many of those differ in content."""
    contents = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    per_id = contents.groupBy(id_col).agg(
        F.sum("_n").alias("_rows"), F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("_full")
    )
    shared = F.col("_rows") > 1
    return per_id.agg(
        F.coalesce(F.sum("_full"), F.lit(0)).alias("rows_in_full_duplicates"),
        F.coalesce(F.sum(F.when(shared, F.col("_rows"))), F.lit(0)).alias("rows_sharing_id"),
        F.coalesce(F.sum(F.when(shared, F.col("_rows") - F.col("_full"))), F.lit(0)).alias("conflicting_rows"),
    )


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once, nulls counted as equal."""
    often = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    test = F.lit(True)
    for k in keys:
        test = test & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return df.alias("l").join(often.alias("r"), test, "left_semi")


def inspect_collisions(df: DataFrame, id_col: str, columns: Sequence[str] | None = None) -> DataFrame:
    shown = columns or [c for c in df.columns if not c.startswith("_")]
    return repeated(df, [id_col]).orderBy(id_col, *[c for c in shown if c != id_col]).select(*shown)


def resolve_collisions(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """Unique ids: the first row by ``order`` keeps its id, later ones get -B, -C, ... and numbers after Z.

    The old id stays in ``Original_<id>``. A new id that already exists as an
    id gets the order value appended.
    """
    letter = F.chr((F.lit(64) + F.col("_rank")).cast("long"))
    mark = F.when(F.col("_rank") <= 26, letter).otherwise(F.col("_rank").cast("string"))
    ranked = numbered(df, order, "_rank", [id_col]).withColumn(
        "_new",
        F.when(F.col("_rank") == 1, F.col(id_col).cast("string")).otherwise(F.concat_ws("-", F.col(id_col).cast("string"), mark)),
    )
    taken = df.select(F.col(id_col).cast("string").alias("_new")).distinct().withColumn("_taken", F.lit(True))
    checked = ranked.join(taken, "_new", "left")
    clash = (F.col("_rank") > 1) & F.coalesce(F.col("_taken"), F.lit(False))
    free = F.when(clash, F.concat_ws("-r", "_new", F.col(order).cast("string"))).otherwise(F.col("_new"))
    return checked.select(
        *[free.alias(c) if c == id_col else F.col(c) for c in df.columns], F.col(id_col).alias(f"Original_{id_col}")
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row per key by ``order``, null last; combines on the map side, so a hot key is no problem."""
    others = [c for c in df.columns if c not in keys]
    place = F.struct(F.col(order).isNull(), F.col(order))
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*others), place).alias("_row"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def enrich(base: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Left join several tables on ``key``; a column already present is not taken again."""
    out = base
    for other in others:
        new = [c for c in other.columns if c not in out.columns]
        out = out.join(other.select(key, *new), key, "left")
    return out


def composite_key(area: Column, county: Column) -> Column:
    """Trimmed lower-case area and county with a bar between them."""
    return F.concat_ws("|", F.lower(F.trim(area)), F.lower(F.trim(county)))


def key_join(left: DataFrame, right: DataFrame, left_cols: tuple[str, str], right_cols: tuple[str, str]) -> DataFrame:
    """Left join on the composite name key with a flag telling whether it matched."""
    keyed = right.withColumn("_key", composite_key(*map(F.col, right_cols))).drop(*right_cols)
    joined = left.withColumn("_key", composite_key(*map(F.col, left_cols))).join(
        keyed.withColumn("key_matched", F.lit(True)), "_key", "left"
    )
    return joined.withColumn("key_matched", F.coalesce("key_matched", F.lit(False))).drop("_key")


def members_of(df: DataFrame, column: str, wanted: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(list(wanted)))


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """Value of a small fixed dictionary, or the default."""
    hits = [F.when(c == k, F.lit(v)) for k, v in table.items()]
    return F.coalesce(*hits, default if default is not None else F.lit(None))


def with_prefix(df: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in columns})
