"""Packing of token ids into sequences by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import id_encoder, numbered, whole_text, written

#: Bytes of ids after which a batch of pieces is handed on.
_HAND_ON = 4 << 20
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def cut_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The ids of every document with its end id, cut into full windows and the rest.

    ``ids`` are little-endian unsigned 32-bit integers; ``start`` counts the ids
    of the document before the piece. A null or empty text is its end id alone.
    Every row gives its own pieces, also where ids repeat; other columns are
    ignored.
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = id_encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        names, kinds = [x.split()[0] for x in PIECES.split(", ")], [pa.int64()] * 4 + [pa.binary()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            rows, held = [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                total = len(ids) // 4
                for at in range(0, total, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    rows.append((i, at, len(piece) // 4, total, piece))
                    held += len(piece)
                    if held >= _HAND_ON:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES).withColumnRenamed("doc_id", id_col)


class OpenWindows:
    """A segment tree over remaining capacities: which of them have open windows."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, first: int, count: int) -> None:
        """``count`` windows from number ``first`` with ``left`` free places."""
        self.runs[left].append((first, count))
        self._count(left, 1)

    def take(self, left: int) -> tuple[int, int]:
        self._count(left, -1)
        return self.runs[left].pop()

    def _count(self, left: int, by: int) -> None:
        at = left + self.leaves
        while at:
            self.open[at] += by
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that has windows."""
        at = length + self.leaves
        if self.open[at]:
            return length
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over pieces that are known by their lengths.

    Pieces of one length are interchangeable and so are windows with one
    remaining capacity, hence whole runs are placed at a time and the work
    depends on the capacity, not on the number of pieces. A row (length, rank,
    count, sequence, offset) puts the pieces of ranks rank..rank+count-1 into
    the sequences from ``sequence`` on, one each.
    """
    windows, plan, fresh = OpenWindows(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            left = windows.tightest(length)
            if left is None:
                each = capacity // length
                left, first, count = capacity, fresh, -(-rest // each)
                fresh += count
            else:
                first, count = windows.take(left)
            # a window that still has room is the tightest for the next piece too
            each = left // length
            full = min(count, rest // each)
            over = rest - full * each if full < count else 0
            for start, n, per in ((first, full, each), (first + full, 1, over)):
                if n and per:
                    for k in range(per):
                        plan.append((length, rank, n, start, capacity - left + k * length))
                        rank += n
                    rest -= n * per
                    if left - per * length:
                        windows.add(left - per * length, start, n)
            used = full + (1 if over else 0)
            if used < count:
                windows.add(left, first + used, count - used)
    return plan


def place_pieces(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` of 1 to ``capacity``.

    The driver sees one count per length, at most ``capacity`` rows. Pieces are
    numbered within their length, in slices; the plan's runs then give each
    number its place. ``pieces`` is read twice, so it should be stored. An
    empty table gives an empty table; all columns of ``pieces`` stay.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"pieces must hold 1 to {capacity} ids")
    plan = sorted(best_fit(counts, capacity))
    spark = pieces.sparkSession

    import numpy as np

    table = spark.sparkContext.broadcast(np.array(plan or [(0, 0, 0, 0, 0)], dtype=np.int64))

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        runs = table.value
        starts = (runs[:, 0] << 44) + runs[:, 1]
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(starts, (length << 44) + rank, side="right") - 1
            ids = runs[at, 3] + rank - runs[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids), pa.array(runs[at, 4])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = numbered(pieces, ["length"], list(order), "_rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(placed, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Packed pieces with their ids: documents are encoded, cut and placed; stored once on the way."""
    return place_pieces(written(cut_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
