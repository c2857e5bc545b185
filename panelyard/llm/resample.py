"""Importance resampling towards a target distribution: bucketed features, Gumbel scores, bracketed cutoff."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import whole_text, written

BUCKETS, WORDS, LEAST, SHARE, SEED = 10_000, 1, 20, 10, 2024
#: Relative error of the first sketch; the bracket reaches twice as far to both sides.
ERROR = 0.001
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_KEPT = 200_000


class _Buckets(dict):
    """Feature -> bucket."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        value = zlib.crc32(feature) % self.buckets
        if len(self) >= _KEPT:
            self.clear()
        if len(feature) <= 48:
            self[feature] = value
        return value


def features(text: bytes, words: int, bucket: _Buckets) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to ``words`` words."""
    found = _WORD.findall(text.lower())  # bytes.lower() changes A-Z only
    runs = found + [b" ".join(found[i : i + k]) for k in range(2, words + 1) for i in range(len(found) - k + 1)]
    return len(found), np.fromiter(map(bucket.__getitem__, runs), dtype=np.int64, count=len(runs))


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, words: int = WORDS) -> np.ndarray:
    """Features per bucket over all rows; a task sends one row per bucket it met, so ``buckets`` rows bound each."""

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, bucket = np.zeros(buckets, np.int64), _Buckets(buckets)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(features(text.as_buffer().to_pybytes(), words, bucket)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    rows = texts.select(whole_text(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of target and source, in thousandths, rounded down."""
    n = len(source)
    s_all, t_all = float(int(source.sum()) + n), float(int(target.sum()) + n)
    ratio = [(float(t) + 1) * s_all / ((float(s) + 1) * t_all) for s, t in zip(source, target)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise of a document in thousandths; a null id counts as no digits."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row; ``gains`` is one array for all tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    buckets = len(gains)

    def weighed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        gain, bucket = shared.value, _Buckets(buckets)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1)):
                n, found = features(text.as_buffer().to_pybytes(), words, bucket)
                weight = int(gain[found].sum())
                out.append((n, len(found), weight, weight + noise(seed, doc_id)))
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long, score long")


def bracket(rows: DataFrame, wanted: int, total: int, error: float = ERROR) -> tuple[int, int, int]:
    """(low, high, rows above high): the row number ``wanted`` from the top scores between low and high, ends included.

    A quantile sketch proposes the bracket, exact counts above and inside it
    prove it; as long as they do not, it is widened fourfold.
    """
    at = 1 - wanted / total
    while True:
        ends = [max(0.0, at - 2 * error), min(1.0, at + 2 * error)]
        low, high = (int(x) for x in rows.approxQuantile("score", ends, min(error, 0.5)))
        if ends == [0.0, 1.0]:
            low, high = rows.agg(F.min("score"), F.max("score")).first()
        found = rows.agg(F.count_if(F.col("score") > high).alias("above"), F.count_if(F.col("score").between(low, high)).alias("inside")).first()
        if found["above"] < wanted <= found["above"] + found["inside"]:
            return low, high, found["above"]
        error *= 4


def _ranked(rows: DataFrame, before: int, name: str) -> DataFrame:
    """``rank`` from ``before`` + 1: highest score first, then smallest id; rows are ranged, sorted in their range, and counted."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("serial")]
    ranged = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    sums = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = F.broadcast(sums.select("part", earlier.alias("earlier")))  # one row per partition
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("within", within).join(sums, "part").select(*rows.columns, (before + F.col("earlier") + F.col("within")).cast("long").alias("rank"))


def draw(rows: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """``rows`` (doc_id, n_words, n_features, weight, score) with ``rank``: ``share`` in 100 of those with ``least`` words, rounded down.

    Ties go to the smaller id, a null id last. Rows that agree in score and id are told apart
    by their place in the table. Rows not drawn have no rank.
    """
    table = written(rows.withColumn("serial", F.monotonically_increasing_id()), "scored")
    fit = table.filter(F.col("n_words") >= least)
    total = fit.count()
    wanted = share * total // 100
    plain = table.drop("serial").withColumn("rank", F.lit(None).cast("long"))
    if not wanted:
        return plain
    low, high, above = bracket(fit, wanted, total)
    best = fit.filter(F.col("score") > high)
    # only the bracket is sorted to find where the draw ends
    edge = _ranked(fit.filter(F.col("score").between(low, high)), above, "edge")
    known = _ranked(best, 0, "best").unionByName(edge)
    known = known.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    outside = table.filter((F.col("n_words") < least) | (F.col("score") < low)).withColumn("rank", F.lit(None).cast("long"))
    return known.unionByName(outside).drop("serial")


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, words: int = WORDS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with n_features, weight, score and, where it is drawn, its rank.

    Features are runs of 1 to ``words`` words, A-Z lower-cased, counted in
    ``buckets`` hash buckets over all of ``docs`` and all of ``target``. A
    row's weight sums the gains of its features; its score adds Gumbel noise
    from seed and id. Of the rows with ``least`` words the ``share`` in 100 of
    the highest scores are drawn.

    Null, empty and wordless texts have no features and weight 0. Null ids are
    scored as ids without digits and come last among equals. Repeated rows count each. An
    empty ``docs`` gives no rows; with an empty ``target`` all gains come from
    the source alone. Other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets, words), bucket_counts(target, target_text, buckets, words))
    drawn = draw(scored(docs, gains, words, seed, id_col, text_col), least, share)
    return drawn.select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank")
