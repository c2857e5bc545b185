"""Equi-joins whose hot keys are spread over several tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], row_id: str, rows_per_task: int = 20_000) -> DataFrame:
    """Inner join on ``keys``; rows of a key above ``rows_per_task`` on either side are salted.

    Only keys above the size get more than one salt, and only the rows they
    meet on the other side are repeated, so nothing is dropped and the common
    keys cost nothing extra. ``row_id`` spreads the right rows, the hash of the
    whole row the left ones.
    """
    keys = list(keys)

    def hot(side: DataFrame, name: str) -> DataFrame:
        sizes = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task)
        return sizes.select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias(name))

    ways = hot(left, "_l").join(hot(right, "_r"), keys, "full_outer")
    many_l, many_r = F.coalesce(F.col("_l"), F.lit(1)), F.coalesce(F.col("_r"), F.lit(1))
    own_l = F.pmod(F.xxhash64(*left.columns), many_l).cast("int")
    own_r = F.pmod(F.xxhash64(row_id), many_r).cast("int")
    salted = right.join(ways, keys, "left").withColumn("_j", own_r).withColumn("_i", F.explode(F.sequence(F.lit(0), many_l - 1)))
    repeated = left.join(ways, keys, "left").withColumn("_i", own_l).withColumn("_j", F.explode(F.sequence(F.lit(0), many_r - 1)))
    return repeated.drop("_l", "_r").join(salted.drop("_l", "_r"), [*keys, "_i", "_j"]).drop("_i", "_j")


def crowd_join(rows: DataFrame, per_key: DataFrame, key: str, size: str, total: int, parts: int = 200) -> DataFrame:
    """Inner join of ``rows`` with one row per key, where a key may hold most rows.

    ``size`` says how many of the ``total`` rows a key has. The keys above
    1/``parts`` of them, ``parts`` at most, reach their rows as a broadcast; the
    others meet in a shuffle whose largest key is that share.
    """
    large = F.col(size) > max(1000, total // parts)
    crowd = F.broadcast(per_key.filter(large).withColumn("_crowd", F.lit(True)))
    met = rows.join(crowd, key, "left")
    columns = [*rows.columns, *[c for c in per_key.columns if c != key]]
    rest = met.filter("_crowd is null").select(*rows.columns).join(per_key.filter(~large), key)
    return met.filter("_crowd").select(*columns).unionByName(rest.select(*columns))
