"""Toxic passages by maximum-scoring segments with extreme-value calibration."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import small_batches, whole_text, written

#: Slots of the hashed word counts; the model is two numbers per slot whatever the corpus holds.
SLOTS = 1 << 20
#: Word starts whose counts are the prior of longer starts and of the word.
STARTS = (3, 4, 5)
#: Weight of a prior in occurrences, and what every word costs, so that neutral text scores below 0.
PRIOR, COST = 3.0, 0.7
#: Labelled rows that are read at most, taken by the hash of their id.
MAX_LABELS = 60_000
_WORD = re.compile(r"\w+")
#: Words a worker keeps at a time: several such tables live in one worker of a pipeline.
_KEPT = 120_000
_BINS = 400


def units(word: str) -> list[int]:
    """Slots of the word's starts, from the shortest, and of the whole word."""
    import xxhash

    found = [word[:k] for k in STARTS if len(word) > k]
    return [xxhash.xxh3_64_intdigest(f"{len(u)} {u}") % SLOTS for u in found] + [xxhash.xxh3_64_intdigest(word) % SLOTS]


class WordScores(dict):
    """Log-odds of words under Dirichlet priors, less ``COST``.

    Every level is smoothed by the one before: the prior of a word is the ratio
    of its longest start, down to even odds. Words never seen have the odds of
    their starts.
    """

    def __init__(self, toxic: np.ndarray, clean: np.ndarray) -> None:
        super().__init__()
        self.toxic, self.clean = toxic, clean
        self.scale = float(toxic[-1]) / max(1.0, float(clean[-1]))

    def __missing__(self, word: str) -> float:
        ratio = 1.0
        for slot in units(word):
            ratio = (self.toxic[slot] + PRIOR * ratio) / (self.clean[slot] * self.scale + PRIOR)
        score = math.log(ratio) - COST
        if len(self) >= _KEPT:
            self.clear()
        if len(word) <= 48:
            self[word] = score
        return score

    def of(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), dtype=np.float64, count=len(words))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) by the linear scan of Ruzzo and Tompa.

    Only positions above 0 can begin a segment, so the scan walks over those
    and takes the sums between them from the running total.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # (start, end, sum before start, sum up to end)
    found: list[tuple[int, int, float, float]] = []
    for at in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = at, at + 1, float(total[at]), float(total[at + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, r - b) for s, e, b, r in found]


@dataclass(frozen=True)
class Calibration:
    """Decay and size of chance segments (Karlin and Altschul), and the logistic curve over the evidence."""

    decay: float
    log_size: float
    base: float
    slope: float

    def evidence(self, found: list[tuple[int, int, float]], words: int) -> float:
        """What significant segments exceed chance by, summed: lambda * score - ln(K * words)."""
        floor = self.log_size + math.log(max(1, words))
        return sum(max(0.0, self.decay * s - max(floor, 0.0)) for _, _, s in found)

    def score(self, evidence: float) -> float:
        x = self.base + self.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


@dataclass(frozen=True)
class ToxicModel:
    toxic: np.ndarray
    clean: np.ndarray
    calibration: Calibration


def held_out(id_col: str):
    """Rows no label may be learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def _learnable(labels: DataFrame, id_col: str, max_labels: int) -> DataFrame:
    rows = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).filter(~held_out(id_col))
    one = rows.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    fold = (F.crc32(F.col("_id").cast("string").cast("binary")) % 3 == 2).alias("_second")
    return one.orderBy(F.xxhash64("_id"), "_id").limit(max_labels).select("_id", "_toxic", fold)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Counts words of labelled rows and calibrates on rows the counts did not see.

    At most ``max_labels`` labelled rows are used, so they may be broadcast.
    Rows with remainder 0 give the words for calibrating on rows with remainder
    2; the final counts are of both. Without labels of both kinds every text
    gets the score 0 or the share of toxic rows.
    """
    spark = docs.sparkSession
    chosen = F.broadcast(_learnable(labels, id_col, max_labels))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("text")).join(chosen, "_id")
    rows = rows.select("_toxic", "_second", "text")

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            sums: dict[tuple[int, int], int] = {}
            for toxic, second, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = _WORD.findall(text.lower())
                group = 2 * int(second) + int(bool(toxic))
                sums[SLOTS, group] = sums.get((SLOTS, group), 0) + len(words)
                for word in words:
                    slots = kept.get(word)
                    if slots is None:
                        if len(kept) >= _KEPT:
                            kept.clear()
                        slots = kept[word] = tuple(units(word))
                    for slot in slots:
                        sums[slot, group] = sums.get((slot, group), 0) + 1
            keys = np.array(list(sums), dtype=np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(sums.values()), pa.int64())], names=["slot", "part", "n"])

    sums = rows.mapInArrow(counted, "slot int, part int, n long").groupBy("slot", "part").agg(F.sum("n").alias("n"))
    # at most SLOTS + 1 slots in four parts
    with small_batches(spark):
        table = sums.toArrow()
    counts = np.zeros((4, SLOTS + 1))
    counts[table["part"].to_numpy(), table["slot"].to_numpy()] = table["n"].to_numpy()
    toxic, clean = counts[1] + counts[3], counts[0] + counts[2]
    first = spark.sparkContext.broadcast((counts[1].astype(np.float32), counts[0].astype(np.float32)))

    def summarised(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = WordScores(*first.value)
        for batch in batches:
            out = []
            seen = np.zeros(_BINS)
            for bad, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                scores = scorer.of(text)
                found = segments(scores)
                out.append((bool(bad), len(scores), [s for _, _, s in found]))
                if not bad:
                    seen += np.bincount(_bin(scores), minlength=_BINS)
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.float64())), pa.array([seen] + [None] * (len(out) - 1), pa.list_(pa.float64()))],
                names=["bad", "words", "found", "seen"],
            )

    second = rows.filter("_second").select((F.col("_toxic") == 1).alias("bad"), "text")
    # at most max_labels rows of a few numbers
    with small_batches(spark):
        calibrated = second.mapInArrow(summarised, "bad boolean, words long, found array<double>, seen array<double>").toArrow()
    return ToxicModel(toxic.astype(np.float32), clean.astype(np.float32), _calibrate(calibrated))


def _bin(scores: np.ndarray) -> np.ndarray:
    """Slots of a histogram from -20 to 20."""
    return np.clip((scores + 20) * (_BINS / 40), 0, _BINS - 1).astype(np.int64)


def _calibrate(table) -> Calibration:
    seen = sum((np.array(x) for x in table["seen"].to_pylist() if x is not None), np.zeros(_BINS))
    rows = list(zip(table["bad"].to_pylist(), table["words"].to_pylist(), table["found"].to_pylist()))
    if not any(bad for bad, _, _ in rows) or all(bad for bad, _, _ in rows):
        share = min(max(np.mean([bad for bad, _, _ in rows]) if rows else 0.0, 1e-6), 1 - 1e-6)
        return Calibration(1.0, 0.0, math.log(share / (1 - share)), 0.0)
    middle = (np.arange(_BINS) + 0.5) * (40 / _BINS) - 20
    share = seen / max(1.0, seen.sum())
    # the decay solves E[exp(decay * score)] = 1 over clean words
    low, high = 0.05, 4.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if float(share @ np.exp(mid * middle)) < 1 else (low, mid)
    decay = low
    # chance maxima follow a Gumbel law: their mean gives the size
    clean = [(n, max(found, default=0.0)) for bad, n, found in rows if not bad and n]
    log_size = float(np.mean([decay * m - math.log(n) for n, m in clean])) - 0.5772156649 if clean else 0.0
    plain = Calibration(decay, log_size, 0.0, 1.0)
    x = np.array([math.log1p(plain.evidence([(0, 0, s) for s in found], n)) for _, n, found in rows])
    y = np.array([bad for bad, _, _ in rows], dtype=float)
    # logistic curve by Newton steps, slightly held to 0
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ design, -60, 60)))
        hessian = (design * (p * (1 - p) + 1e-6)) @ design.T + 0.1 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hessian, design @ (y - p) - 0.1 * w), -2, 2)
    return Calibration(decay, log_size, float(w[0]), float(w[1]))


@functools.lru_cache(maxsize=1)
def _scorer(name: int, model) -> tuple[WordScores, Calibration]:
    held = model.value
    return WordScores(held.toxic, held.clean), held.calibration


def passages(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` and the significant passages of every row's whole text.

    ``passages`` holds (start, end, evidence) in words. Null, empty and wordless
    texts have no passage and the score of no evidence. Every row gives one
    row, repeated ids too; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer, rule = _scorer(id(shared), shared)
        for batch in batches:
            score, spans = [], []
            for text in batch.column(1).to_pylist():
                scores = scorer.of(text)
                found = segments(scores)
                score.append(rule.score(rule.evidence(found, len(scores))))
                spans.append([(s, e, x) for s, e, p in found if (x := rule.evidence([(s, e, p)], len(scores))) > 0])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))
            rows = [[{"start": s, "end": e, "evidence": x} for s, e, x in span] for span in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(rows, kind)], names=["id", "score", "passages"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"id {kind}, score double, passages array<struct<start:int,end:int,evidence:double>>").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is below ``threshold``; stored once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def kept(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer, rule = _scorer(id(shared), shared)
        for batch in batches:
            keep = []
            for text in batch.column(at).to_pylist():
                scores = scorer.of(text or "")
                keep.append(rule.score(rule.evidence(segments(scores), len(scores))) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return written(docs.mapInArrow(kept, docs.schema), "kept")
