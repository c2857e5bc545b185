"""Word sets that overlap by a Jaccard share: blocks of records compared by matrix products.

Few records of different events agree, but very many share some words, so an
equi-join on words meets almost all pairs. Here blocks of records are packed
into one row each, and parts of blocks meet in a Cartesian product, which reads
them again instead of shuffling copies. Words are 64-bit names and become places
of a 0/1 row per record, more places for longer records; the product of two
such rows, plus the words that share a place, bounds the common words from
above. The few pairs that pass are bounded again by rows of bits, and what is
left is counted name by name: exact but for two words of a pair that share a name.
Work grows with the pairs that county, date and size allow; disk with the
records, memory with two parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.operators.parts import each_meeting, meeting, records_as_bytes, records_of, row_of, upper_half
from panelyard.session import checkpointed, released

#: Records and words of a block at most (a longer record is a block of its own).
ROWS, WORDS = 1024, 300_000
#: Blocks of a part at least, where there are enough.
READ = 16
#: Places of a record's row at most and at least (powers of two count), and for each word of the longest record of a product.
PLACES, OWN, ROOM = 2048, 256, 3
#: Records a side of one matrix product; bits of a record, a multiple of its places.
TILE, BITS = 256, 16_384

_ODD = np.uint64(0x9E3779B97F4A7C15)
_VIEWS = {8: np.uint8, 16: np.uint16, 32: np.uint32, 64: np.uint64}


def packed(side: DataFrame) -> DataFrame:
    """Parts of blocks of records that lie close in county and day, with the range of both."""
    n, words = side.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    cores = side.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / ROWS), math.ceil(words / WORDS))
    # enough pairs of parts for all cores, few enough to read a block seldom
    parts = max(math.ceil(blocks / max(READ, math.ceil(blocks / 128))), min(math.ceil(n / 500), math.ceil(math.sqrt(6 * cores))), 1)
    rows_at_most, words_at_most = ROWS, WORDS

    facts = [("c0", pa.string()), ("c1", pa.string()), ("any_c", pa.bool_()), ("d0", pa.date32()), ("d1", pa.date32()), ("any_d", pa.bool_())]
    schema = pa.schema([*facts, ("first", pa.bool_()), ("held", pa.binary())])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[pa.RecordBatch] = []
        n = words = done = 0
        def out() -> Iterator[pa.RecordBatch]:
            if not done:
                yield row_of([], None, False, schema)
            rows = pa.Table.from_batches(gathered).combine_chunks()
            county, day = (pc.min_max(rows[c]).as_py() for c in ("county", "day"))
            facts = [county["min"], county["max"], rows["county"].null_count > 0, day["min"], day["max"], rows["day"].null_count > 0]
            yield row_of(facts, records_as_bytes(rows), not done, schema)

        for batch in batches:
            sizes = np.cumsum(pc.list_value_length(batch.column("codes")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(sizes):
                before = sizes[at - 1] if at else 0
                end = min(at + rows_at_most - n, int(np.searchsorted(sizes, before + words_at_most - words, side="right")))
                if end <= at and n == 0:
                    end = at + 1
                if end > at:
                    gathered.append(batch.slice(at, end - at))
                    n, words, at = n + end - at, words + int(sizes[end - 1] - before), end
                if at < len(sizes):
                    yield from out()
                    gathered, n, words, done = [], 0, 0, done + 1
        if n:
            yield from out()

    rows = side.select("record", "copies", F.col("county").cast("string").alias("county"), "day", F.array_join("words", " ").alias("words"))
    rows = rows.repartitionByRange(parts, "county", "day", "record").coalesce(parts).sortWithinPartitions("county", "day")
    names = F.transform(F.split("words", " "), lambda w: F.xxhash64(w))
    kind = "c0 string, c1 string, any_c boolean, d0 date, d1 date, any_d boolean, first boolean, held binary"
    held = rows.select("record", "copies", "county", "day", names.alias("codes")).mapInArrow(block, kind)
    with released(side.sparkSession):
        return checkpointed(held.withColumn("block", F.monotonically_increasing_id()))


def _may_meet(window_days: int) -> Column:
    """Whether some records of two blocks may agree in county and date."""
    county = F.col("a.any_c") | F.col("b.any_c") | ((F.col("a.c0") <= F.col("b.c1")) & (F.col("b.c0") <= F.col("a.c1")))
    day = F.col("a.any_d") | F.col("b.any_d") | (
        (F.datediff("a.d0", "b.d1") <= window_days) & (F.datediff("b.d0", "a.d1") <= window_days)
    )
    return county & day


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class _Side:
    """The records of one block, shortest first; ``codes`` are all their words, ``start`` where each record's begin."""

    def __init__(self, rows: pa.Table):
        lists = rows["codes"].combine_chunks()
        codes = lists.flatten().to_numpy().view(np.uint64) * _ODD
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        self.order = order = np.argsort(sizes, kind="stable")
        ends = np.cumsum(sizes)
        self.sizes = sizes[order]
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        self.codes = codes[_ranges((ends - sizes)[order], self.sizes)]
        counties = rows["county"].combine_chunks().dictionary_encode()
        self.names = counties.dictionary.to_pylist()
        self.counties = pc.fill_null(counties.indices, -1).to_numpy(zero_copy_only=False)[order]
        self.days = rows["day"].cast(pa.int32()).cast(pa.float32()).to_numpy()[order]
        self.rows = rows.select(["record", "copies"])
        self.kept: np.ndarray | None = None

    def bits(self) -> np.ndarray:
        """A bit for each of many places, set where a word has its place."""
        if self.kept is None:
            self.kept = np.zeros((len(self.sizes), BITS // 64), dtype=np.uint64)
            for low in range(0, len(self.sizes), 256):
                high = min(low + 256, len(self.sizes))
                x = np.zeros((high - low, BITS), dtype=bool)
                places = (self.codes[self.start[low] : self.start[high]] >> np.uint64(32)) * np.uint64(BITS) >> np.uint64(32)
                x[np.repeat(np.arange(high - low), self.sizes[low:high]), places.astype(np.int64)] = True
                self.kept[low:high] = np.packbits(x, axis=1).view(np.uint64)
            self.crowd = self.sizes - np.bitwise_count(self.kept).sum(axis=1, dtype=np.int64)
        return self.kept

    def tile(self, low: int, high: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """0/1 rows of some records, a place for every few bits, and how many of their words share a place."""
        bits, share = self.bits()[low:high], BITS // width
        if share in _VIEWS:
            x = bits.view(_VIEWS[share]) != 0
        else:
            x = np.unpackbits(bits.view(np.uint8), axis=1).reshape(high - low, width, share).any(axis=2)
        x = x.astype(np.float32)
        return x, self.sizes[low:high].astype(np.float32) - x.sum(axis=1)


def _most(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common words at most, from rows of bits."""
    out = np.empty(len(i), dtype=np.int64)
    for at in range(0, len(i), 1024):
        x, y = i[at : at + 1024], j[at : at + 1024]
        out[at : at + 1024] = np.bitwise_count(a.bits()[x] & b.bits()[y]).sum(axis=1, dtype=np.int64) + np.minimum(a.crowd[x], b.crowd[y])
    return out


def _shared(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common words of every pair (i, j); ``i`` comes sorted."""
    out = np.empty(len(i), dtype=np.int64)
    firsts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
    for low, high in zip(firsts, [*firsts[1:], len(i)]):
        own = np.sort(a.codes[a.start[i[low]] : a.start[i[low] + 1]])
        for k in range(low, high, 4096):
            others = j[k : min(k + 4096, high)]
            theirs = b.codes[_ranges(b.start[others], b.sizes[others])]
            hits = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            begins = np.concatenate([[0], np.cumsum(b.sizes[others])[:-1]])
            out[k : k + len(others)] = np.add.reduceat(hits, begins, dtype=np.int64)
    return out


def _alike(a: _Side, b: _Side, one: bool, threshold: float, window: int) -> Iterator:
    """(i, j, similarity) arrays of the pairs at the threshold; ``one``: both sides are the same block."""
    share = threshold / (1.0 + threshold)
    known = {name: k for k, name in enumerate(a.names)}
    theirs = np.array([*(known.get(name, -2 - k) for k, name in enumerate(b.names)), -1])[b.counties]
    widths = [1 << k for k in range(20) if OWN <= 1 << k <= PLACES]
    for low in range(0, len(a.sizes), TILE):
        high = min(low + TILE, len(a.sizes))
        need_a = share * a.sizes[low:high].astype(np.float32)
        mine: dict = {}
        found = []
        for left in range(low if one else 0, len(b.sizes), TILE):
            right = min(left + TILE, len(b.sizes))
            # records come by size: all of a tile may be too short for all of the other
            if b.sizes[right - 1] < threshold * a.sizes[low] - 1e-6 or a.sizes[high - 1] < threshold * b.sizes[left] - 1e-6:
                continue
            width = next((w for w in widths if w >= ROOM * max(a.sizes[high - 1], b.sizes[right - 1])), widths[-1])
            if width not in mine:
                mine[width] = a.tile(low, high, width)
            (x, crowd_a), (y, crowd_b) = mine[width], b.tile(left, right, width)
            most = x @ y.T
            most += np.minimum(crowd_a[:, None], crowd_b[None, :])
            # far more slack than single precision needs
            most -= need_a[:, None] - 0.05
            i, j = np.nonzero(most >= share * b.sizes[left:right].astype(np.float32))
            i, j = i + low, j + left
            near = ~(np.abs(a.days[i] - b.days[j]) > window)
            near &= (a.counties[i] == theirs[j]) | (a.counties[i] < 0) | (theirs[j] == -1)
            near &= np.minimum(a.sizes[i], b.sizes[j]) >= threshold * np.maximum(a.sizes[i], b.sizes[j]) - 1e-6
            if one:
                near &= i < j
            found.append((i[near], j[near]))
        i, j = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        if not len(i):
            continue
        good = _most(a, b, i, j) >= share * (a.sizes[i] + b.sizes[j]) - 1e-6
        i, j = i[good], j[good]
        by = np.argsort(i, kind="stable")
        i, j = i[by], j[by]
        common = _shared(a, b, i, j)
        similarity = common / (a.sizes[i] + b.sizes[j] - common)
        good = similarity >= threshold
        yield i[good], j[good], similarity[good]


def _pairs(a: _Side, b: _Side, one: bool, same: bool, threshold: float, window: int, out: pa.Schema) -> Iterator[pa.Table]:
    for i, j, similarity in _alike(a, b, one, threshold, window):
        left, right = (s.rows.take(pa.array(s.order[k])) for s, k in ((a, i), (b, j)))
        ids, copies = [left["record"], right["record"]], [left["copies"], right["copies"]]
        if same:
            first = pc.less(ids[0], ids[1])
            ids = [pc.if_else(first, *ids), pc.if_else(first, ids[1], ids[0])]
            copies = [pc.if_else(first, *copies), pc.if_else(first, copies[1], copies[0])]
        yield pa.table([*ids, *copies, pa.array(similarity)], schema=out)


def _meet(rows: pa.Table, threshold: float, window: int, same: bool, out: pa.Schema) -> pa.Table:
    """All similar pairs of the two blocks (or the one block) of a table whose ``words`` are texts."""
    lists = pc.split_pattern(rows["words"].combine_chunks(), " ")
    names = lists.flatten().dictionary_encode().indices.cast(pa.int64())
    rows = rows.drop_columns(["words"]).append_column("codes", pa.ListArray.from_arrays(lists.offsets, names))
    one = same and not pc.any(pc.equal(rows["side"], 1)).as_py()
    a = _Side(rows.filter(pc.equal(rows["side"], 0)))
    b = a if one else _Side(rows.filter(pc.equal(rows["side"], 1)))
    return pa.concat_tables([out.empty_table(), *_pairs(a, b, one, same, threshold, window, out)])


def overlapping(left: DataFrame, right: DataFrame, threshold: float, window_days: int, same: bool) -> DataFrame:
    """(a_record, b_record, a_copies, b_copies, similarity) of the variants at the Jaccard threshold.

    Counties agree or one is unknown, dates are at most ``window_days`` apart
    or one is unknown. With ``same`` both are one set and a_record is smaller.
    """
    a = packed(left)
    return blocks_overlapping(a, a if same else packed(right), left.schema["record"].dataType, right.schema["record"].dataType, threshold, window_days, same)


def blocks_overlapping(left: DataFrame, right: DataFrame, kind_a: T.DataType, kind_b: T.DataType, threshold: float, window_days: int, same: bool) -> DataFrame:
    """The same over ``packed`` blocks; the kinds are those of their records."""
    from pyspark.sql.pandas.types import to_arrow_schema

    meets = _may_meet(window_days)
    if same:
        meets = meets & upper_half()
    kind = T.StructType(
        [T.StructField("a_record", kind_a), T.StructField("b_record", kind_b)]
        + [T.StructField(f"{s}_copies", T.LongType()) for s in "ab"] + [T.StructField("similarity", T.DoubleType())]
    )
    out = to_arrow_schema(kind)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, equal in each_meeting(batches, lambda held: _Side(records_of(held))):
            one = same and equal
            for table in _pairs(a, a if one else b, one, same, threshold, window_days, out):
                yield from table.combine_chunks().to_batches()

    return meeting(left, right, meets).mapInArrow(task, kind)
