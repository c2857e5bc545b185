"""Exact de-duplication over a cuckoo-filter index of live digests."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import join_groups, whole_text, written

#: Digests a bucket of the index holds on average.
PER_BUCKET = 50_000
#: Digests that a task holds before it passes them on.
GATHERED = 100_000
_SLOTS, _KICKS = 4, 200
#: Stands for a group without any id, below all ids.
_NO_ID = -(2**63)
CONTENT = "bucket int, digest binary, keep_id long, group_size long"


class CuckooFilter:
    """Set of digests with deletion: 16-bit fingerprints, four slots in each of two cells.

    The cells follow from the digest, so a fingerprint moves between them
    without its key. ``insert`` returns False when the kicks run out; the owner
    then calls ``resized`` with the keys it stores.
    """

    def __init__(self, keys: int) -> None:
        self.cells = 1 << max(1, (max(1, keys) * 5 // (_SLOTS * 4)).bit_length())
        self.table: list[list[int]] = [[] for _ in range(self.cells)]
        self.turn = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[4:6], "little") or 1
        first = int.from_bytes(digest[8:16], "little") % self.cells
        return mark, first, first ^ self._jump(mark)

    def _jump(self, mark: int) -> int:
        return (mark * 0x5BD1E995 >> 3) % self.cells | 1

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.table[a] or mark in self.table[b]

    def insert(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for cell in (a, b):
            if len(self.table[cell]) < _SLOTS:
                self.table[cell].append(mark)
                return True
        undo, cell = [], a
        for _ in range(_KICKS):
            self.turn = (self.turn + 1) % _SLOTS
            undo.append((cell, self.turn, self.table[cell][self.turn]))
            mark, self.table[cell][self.turn] = self.table[cell][self.turn], mark
            cell ^= self._jump(mark)
            if len(self.table[cell]) < _SLOTS:
                self.table[cell].append(mark)
                return True
        for cell, slot, mark in reversed(undo):
            self.table[cell][slot] = mark
        return False

    def delete(self, digest: bytes) -> None:
        mark, a, b = self._places(digest)
        self.table[a if mark in self.table[a] else b].remove(mark)

    def resized(self, keys: Iterable[bytes]) -> CuckooFilter:
        """A filter of at least twice the cells with the stored keys."""
        cells = 2 * self.cells
        while True:
            bigger = CuckooFilter(1)
            bigger.cells, bigger.table = cells, [[] for _ in range(cells)]
            if all(map(bigger.insert, keys)):
                return bigger
            cells *= 2


class LiveIndex:
    """One bucket: the filter and its content, digest -> [keep_id, group_size]."""

    def __init__(self, content: dict[bytes, list[int]] | None = None, keys: int = 0) -> None:
        self.content = content or {}
        self.filter = CuckooFilter(max(keys, len(self.content)))
        if not all(map(self.filter.insert, self.content)):
            self.filter = self.filter.resized(self.content)

    def insert(self, digest: bytes, keep_id: int, size: int) -> None:
        # a hit may be another digest with the same fingerprint: the content decides
        held = self.content.get(digest) if digest in self.filter else None
        if held is None:
            self.content[digest] = [keep_id, size]
            if not self.filter.insert(digest):
                self.filter = self.filter.resized(self.content)
        else:
            held[0], held[1] = max(held[0], keep_id), held[1] + size

    def delete(self, digest: bytes, size: int) -> None:
        """Takes ``size`` rows away; the digest leaves the filter with its last row. Unknown digests change nothing."""
        held = self.content.get(digest) if digest in self.filter else None
        if held is None:
            return
        held[1] -= size
        if held[1] <= 0:
            del self.content[digest]
            self.filter.delete(digest)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the UTF-8 text with A-Z lower-cased; null counts as empty."""

    def hashed(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            # bytes.lower() changes A-Z only
            out = [hashlib.sha256(t.as_buffer().to_pybytes().lower()).digest() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, digest binary")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


def buckets_for(rows: int) -> int:
    """Buckets for so many rows: they stay of one size while their number grows."""
    return max(256, 1 << (rows // PER_BUCKET).bit_length())


def partial(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, digest, keep_id, group_size): the copies that lie close together in one task, as one row.

    A task passes its digests on when it holds ``GATHERED``, so a group of any
    size is a few rows per task; equal digests of other tasks meet in the index.
    """

    def gathered(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def passed(held: dict) -> pa.RecordBatch:
            ids, sizes = ([v[k] for v in held.values()] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], names=["digest", "keep_id", "group_size"])

        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for doc_id, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                group = held.setdefault(digest, [_NO_ID, 0])
                group[0] = max(group[0], _NO_ID if doc_id is None else doc_id)
                group[1] += 1
            if len(held) >= GATHERED:
                yield passed(held)
                held = {}
        if held:
            yield passed(held)

    found = rows.select("doc_id", "digest").mapInArrow(gathered, "digest binary, keep_id long, group_size long")
    return found.select(_bucket(buckets), "digest", "keep_id", "group_size")


def insert_digests(rows: DataFrame, buckets: int, content: DataFrame | None = None) -> DataFrame:
    """The content of the index after inserting ``rows`` (doc_id, digest).

    Tasks send their digests to the buckets of the index. Each bucket inserts
    them into its cuckoo filter: a miss is a new digest; a hit is verified
    against the bucket's content and joins the group there; overflow rebuilds a
    larger filter from the stored digests. ``content`` is an earlier result with
    as many ``buckets``. ``keep_id`` is the largest id, ``group_size`` the rows.
    """
    return _changed(partial(rows, buckets), content, lambda index, d, i, n: index.insert(d, i, n))


def delete_digests(rows: DataFrame, buckets: int, content: DataFrame) -> DataFrame:
    """The content after taking out ``rows`` (doc_id, digest).

    ``group_size`` falls by the rows taken; a digest without rows leaves filter
    and content. ``keep_id`` stays the largest id ever inserted for a live digest.
    """
    return _changed(partial(rows, buckets), content, lambda index, d, i, n: index.delete(d, n))


def _changed(rows: DataFrame, content: DataFrame | None, change) -> DataFrame:
    import pandas as pd

    # a null would turn the ids of its bucket into floats
    content = content.withColumn("keep_id", F.coalesce("keep_id", F.lit(_NO_ID))) if content is not None else None

    def run(index: LiveIndex, frame: pd.DataFrame, bucket: int) -> pd.DataFrame:
        for d, i, n in zip(frame["digest"], frame["keep_id"], frame["group_size"]):
            change(index, bytes(d), int(i), int(n))
        out = [(bucket, d, i, n) for d, (i, n) in index.content.items()]
        return pd.DataFrame(out, columns=["bucket", "digest", "keep_id", "group_size"])

    if content is None:
        return _nulled(rows.groupBy("bucket").applyInPandas(lambda key, frame: run(LiveIndex(keys=len(frame)), frame, key[0]), CONTENT))

    def both(key, held: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        stored = {bytes(d): [int(i), int(n)] for d, i, n in zip(held["digest"], held["keep_id"], held["group_size"])}
        return run(LiveIndex(stored), frame, key[0])

    return _nulled(content.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInPandas(both, CONTENT))


def _nulled(content: DataFrame) -> DataFrame:
    return content.withColumn("keep_id", F.nullif("keep_id", F.lit(_NO_ID)))


def _live(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """The digest of every row, the content of the index over them, and the number of rows."""
    rows = written(digests(docs, id_col, text_col), "digests")
    n = rows.count()
    return rows, written(insert_digests(rows, buckets_for(n)).drop("bucket"), "live"), n


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its group: doc_id, digest, keep_id, group_size, kept.

    Texts are equal when they agree after lower-casing A-Z; null is the empty
    text. The largest id of a group is kept; rows repeating that id are all
    kept. Null ids are never the largest. An empty table gives no rows.
    """
    rows, content, n = _live(docs, id_col, text_col)
    every = join_groups(rows, content, "digest", "group_size", n)
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumnRenamed("doc_id", id_col)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group of equal texts: that with the largest id.

    Of rows that agree in id and text one stays, whichever; a group without any
    id keeps one row too.
    """
    rows, content, n = _live(docs, id_col, text_col)
    names = docs.columns

    # columns are carried by place, so their names cannot clash
    carried = docs.toDF(*[f"_c{k}" for k in range(len(names))])
    own = f"_c{names.index(id_col)}"
    lowered = F.translate(whole_text(f"_c{names.index(text_col)}"), string.ascii_uppercase, string.ascii_lowercase)
    marked = carried.withColumn("_digest", F.unhex(F.sha2(lowered.cast("binary"), 256)))
    kept = join_groups(marked, content.withColumnRenamed("digest", "_digest"), "_digest", "group_size", n)
    kept = kept.filter(F.col(own).cast("long").eqNullSafe(F.col("keep_id")))
    if not rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        same = Window.partitionBy("_digest").orderBy(own)
        kept = kept.withColumn("_nth", F.row_number().over(same)).filter("_nth = 1")
    return kept.select(*[f"_c{k}" for k in range(len(names))]).toDF(*names)
