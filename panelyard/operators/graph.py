"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators.hotkeys import crowd_join
from panelyard.session import checkpointed


def connected_components(vertices: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``component`` = smallest vertex of the component, for every vertex.

    ``edges`` has columns a and b. Neighbour sets are never collected: each
    step needs only the smallest neighbour per vertex, which combines on the
    map side. A vertex with very many neighbours meets its minimum without a
    shuffle. Rounds grow with the logarithm of the longest chain and end when
    nothing changes.
    """
    links = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last, total = None, links.count()
    while True:
        # large star: larger neighbours of u move to the smallest vertex around u
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        moved = crowd_join(both.filter("v > u"), least, "u", "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # small star: smaller neighbours of u and u itself move to the smallest of them
        small = moved.groupBy("u").agg(F.min("v").alias("m"))
        joined = moved.join(small, "u")
        kept = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        links = checkpointed(kept.distinct())
        mark = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == last:
            break
        last, total = mark, mark["n"]
    root = links.select(F.col("u").alias(key), F.col("v").alias("component"))
    return vertices.select(key).join(root, key, "left").withColumn("component", F.coalesce("component", F.col(key)))
