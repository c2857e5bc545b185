"""Balanced shards by label propagation over linked rows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import join_groups, numbered, slices, whole_text, written

#: Rounds at most; a round that moves nothing ends them before. What is not moved by then cuts edges but breaks no quota.
MAX_ROUNDS = 12
#: Classes of gains, by powers of two.
LEVELS = 40


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, group): UTF-8 bytes plus 1, the checksum and the digest that equal texts share; null is the empty text."""
    text = whole_text(text_col).cast("binary")
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("group")
    )


def _running(df: DataFrame, key: str, level: str, value: str, out: str) -> DataFrame:
    """The sum of ``value`` over the rows of ``key`` before this one, by level and then slice.

    One row per (key, level, slice) meets in the window over all of a key; the
    rows themselves are summed within their slice.
    """
    n = slices(df.sparkSession)
    part = df.withColumn("_slice", F.pmod(F.xxhash64("group", "shard"), F.lit(n)))
    cell = [key, level, "_slice"]
    sums = part.groupBy(*cell).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy(level, "_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*cell, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*cell).orderBy("group", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = part.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, cell)
    return placed.select(*df.columns, (F.col("_before") + F.col("_within")).alias(out))


def propagate(blocks: DataFrame, total: int, shards: int, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Moves linked rows towards the shard that holds most of their group, under the shards' quotas.

    ``blocks`` has a row (group, shard, n) per group and shard it touches; rows
    of one group and shard are neighbours with the same wish, so a group of any
    size is at most ``shards`` rows and its links are never listed. In each
    round a block asks for the shard with most of its neighbours; of equal ones
    the hash of group and round decides. Between two shards as many rows move
    one way as the other, and more as far as the quota has room. The largest
    gains go first and the last block is split. When no such move is left,
    blocks ask for the best shard with room. Rounds end when neither moves a
    row. Cut edges only fall: rows join blocks at least as large as their own.
    """
    blocks, still = written(blocks, "blocks"), 0
    for turn in range(max_rounds):
        free = _free(blocks, total, shards)
        asked = blocks if not still else blocks.filter(F.get(F.array(*[F.lit(x).cast("long") for x in free]), F.col("shard")) > 0)
        draw = F.xxhash64("group", "shard", F.lit(turn))
        wish = asked.groupBy("group").agg(F.max(F.struct(F.col("n"), draw.alias("draw"), F.col("shard"))).alias("w"))
        wish = wish.select("group", F.col("w.n").alias("there"), F.col("w.shard").alias("to"))
        ask = blocks.join(wish, "group").filter((F.col("shard") != F.col("to")) & (F.col("n") <= F.col("there")))
        gain = F.col("there") - F.col("n")
        level = -F.least(F.lit(LEVELS), F.floor(F.log2(gain + 1))).cast("int")
        ask = written(ask.select("group", "shard", "to", "n", (F.col("shard") * shards + F.col("to")).alias("way"), level.alias("level")), "asked")
        # one number per pair of shards
        wanted = {r["way"]: r["n"] for r in ask.groupBy("way").agg(F.sum("n").alias("n")).collect()}
        allowed = F.array(*[F.lit(x).cast("long") for x in _flows(wanted, free, shards)])
        ask = _running(ask, "way", "level", "n", "ahead")
        moves = F.greatest(F.lit(0), F.least(F.col("n"), F.get(allowed, F.col("way")) - F.col("ahead")))
        moved = written(ask.withColumn("moves", moves).filter("moves > 0").select("group", "shard", "to", "moves"), "moves")
        still = still + 1 if moved.isEmpty() else 0
        if still == 2:
            break
        if still:
            continue
        gone = moved.select("group", "shard", (-F.col("moves")).alias("n"))
        come = moved.select("group", F.col("to").alias("shard"), F.col("moves").alias("n"))
        blocks = written(blocks.unionByName(gone).unionByName(come).groupBy("group", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "blocks")
    return blocks


def _flows(wanted: dict[int, int], free: list[int], shards: int) -> list[int]:
    """Rows that may move from shard i to shard j, at place i * shards + j: exchanges of equal numbers, then room in turn."""
    want = [wanted.get(k, 0) for k in range(shards * shards)]
    flow = [min(want[i * shards + j], want[j * shards + i]) for i in range(shards) for j in range(shards)]
    for j in range(shards):
        room = free[j]
        for i in range(shards):
            more = min(room, want[i * shards + j] - flow[i * shards + j])
            flow[i * shards + j] += more
            room -= more
    return flow


def _free(blocks: DataFrame, total: int, shards: int) -> list[int]:
    """Rows each shard may still take; quotas differ by one at most. One row per shard reaches the driver."""
    held = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [total // shards + (s < total % shards) - held.get(s, 0) for s in range(shards)]


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row in a shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: counts of shards are at most one apart. Equal texts
    are linked. Rows are first dealt out in turn; linked rows then move by
    label propagation, and rows without links, which cut no edge anywhere, fill
    the shards up to their quotas. ``slot`` numbers the rows of a shard from 0
    without gaps. Null counts as the empty text; null and repeated ids are
    rows like others. An empty table gives no rows; other columns are ignored.
    """
    named = described(docs, id_col, text_col).withColumn("all", F.lit(0))
    base = written(numbered(written(named, "described"), ["all"], ["doc_id", "group"], "turn").withColumn("shard", (F.col("turn") % shards).cast("int")), "dealt")
    total = base.count()
    sizes = base.groupBy("group").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    groups = written(sizes, "groups")
    linked = written(join_groups(base, groups, "group", "members", total).drop("members"), "linked")
    blocks = propagate(linked.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n")), total, shards)
    # a group's ranges of ranks, at most one per shard
    before = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.withColumn("low", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranges = ranges.groupBy("group").agg(F.collect_list(F.struct("low", "n", "shard")).alias("ranges"), F.sum("n").alias("members"))
    ranked = numbered(linked.drop("shard"), ["group"], ["turn"], "rank")
    hit = F.filter("ranges", lambda r: (F.col("rank") >= r["low"]) & (F.col("rank") < r["low"] + r["n"]))
    placed = join_groups(ranked, written(ranges, "ranges"), "group", "members", total)
    placed = placed.select("doc_id", "size", "text_crc32", F.element_at(hit, 1)["shard"].alias("shard"))
    # rows without links fill what is left
    alone = join_groups(base, groups, "group", "members", total, missing=True).drop("shard")
    alone = numbered(alone, ["all"], ["turn"], "rank")
    bound, below = F.lit(None).cast("int"), 0
    ends = []
    for shard, free in enumerate(_free(blocks, total, shards)):
        below += free
        ends.append((below, shard))
    for end, shard in reversed(ends):
        bound = F.when(F.col("rank") < end, F.lit(shard)).otherwise(bound)
    filled = alone.select("doc_id", "size", "text_crc32", bound.alias("shard"))
    out = numbered(written(placed.unionByName(filled), "sharded"), ["shard"], ["doc_id", "text_crc32"], "slot")
    return out.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
