"""Passages that repeat across documents, found by recompression: named token runs and pairs, level by level."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import join_groups, possible, whole_text, written
from panelyard.llm.minhash import mixed

#: Words of a window, and bytes of its key.
WINDOW, KEY_BYTES = 50, 12
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_WORDS_KEPT = 120_000
_RUN, _LEFT, _RIGHT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Odd factors of the two rolling hashes, and their inverses modulo 2^64.
_FACTORS = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(f, -1, 1 << 64) for f in _FACTORS)
#: A span that no run of names reaches.
_NEVER = (1 << 31) - 1


class _Names(dict):
    """Word -> 64-bit name, the same in every task."""

    @functools.cached_property
    def named(self):
        import xxhash

        return xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self.named(word)
        if len(self) >= _WORDS_KEPT:
            self.clear()
        if len(word) <= 48:
            self[word] = value
        return value


_names = _Names()


def split_words(text: bytes) -> list[bytes]:
    return _WORD.findall(text)


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_names.__getitem__, words), dtype=np.uint64, count=len(words))


def rounds_for(window: int) -> int:
    """Levels after which windows still hold several names of their own.

    A level makes names a third longer on average and takes one and a half
    names from each end of a window; up to three fifths of the window may go.
    Long names are few, and those of different passages are seldom equal.
    """
    level, lost, size = 0, 0.0, 1.0
    while lost + 3 * size <= 0.6 * window:
        level, lost, size = level + 1, lost + 3 * size, size * 4 / 3
    return max(1, level)


class Parse:
    """Texts laid end to end and compressed level by level.

    A level first names every run of one name, then every pair of a left and
    a right name; the name's hash says which side it is on. Equal stretches of
    words get equal names except for a few at their ends: ``left[p]`` is the
    first name that a window starting at word p determines by itself, and
    ``right[q]`` the one behind the last for a window ending before word q.
    """

    def __init__(self, names: np.ndarray, sizes: np.ndarray, rounds: int) -> None:
        n = len(names)
        starts = np.cumsum(sizes) - sizes
        head = np.zeros(n, bool)
        head[starts[sizes > 0]] = True
        self.names, self.head, self.at = names, head, np.arange(n)
        maps = []
        for level in range(1, rounds + 1):
            if n:
                (left, right), (then_left, then_right) = self._runs(), self._pairs(level)
                maps.append((then_left[left], then_right[right]))
        # from the last step back, so that few of the maps are as long as the texts
        self.left = self.right = np.arange(len(self.names) + 1, dtype=np.int32)
        while maps:
            left, right = maps.pop()
            self.left, self.right = self.left[left], self.right[right]

    def _keep(self, first: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Keeps the names at ``first``; where each old name went."""
        place = np.append(np.cumsum(first, dtype=np.int32) - np.int32(1), np.int32(np.count_nonzero(first)))
        self.names, self.head, self.at = names[first], self.head[first], self.at[first]
        return place

    def _runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Names every run; where a window's first name and the one behind its last go."""
        names = self.names
        first = np.append(True, names[1:] != names[:-1]) | self.head
        length = np.diff(np.append(np.flatnonzero(first), len(names))).astype(np.uint64)
        named = names.copy()
        named[first] = np.where(length > 1, mixed(names[first] + length * _RUN), names[first])
        place = self._keep(first, named)
        # a run at the edge of a window may go on outside
        return np.minimum(place + np.int32(1), np.int32(len(self.names))), np.append(np.int32(0), place[:-1])

    def _pairs(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Names every pair; where a window's first name and the one behind its last go."""
        names = self.names
        on_right = (mixed(names ^ mixed(np.full(1, level, np.uint64))) & np.uint64(1)).astype(bool)
        pair = np.append(~on_right[:-1] & on_right[1:] & ~self.head[1:], False)
        first = np.append(True, ~pair[:-1])
        follower = np.append(names[1:], np.uint64(0))
        named = np.where(pair, mixed(names * _LEFT + follower * _RIGHT + np.uint64(level)), names)
        # a right name at the start of a window may end a pair, a left name at its end may begin one
        left = np.arange(len(names) + 1) + np.append(on_right, False)
        right = np.append(0, np.arange(len(names)) + on_right)
        place = self._keep(first, named)
        return place[left], np.where(right > 0, place[right - 1] + np.int32(1), np.int32(0))


def window_starts(sizes: np.ndarray, window: int) -> np.ndarray:
    """The words at which a window lies within its text."""
    count = np.maximum(sizes - window + 1, 0)
    starts = np.cumsum(sizes) - sizes
    return np.repeat(starts - np.cumsum(count) + count, count) + np.arange(count.sum())


def window_keys(names: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Two 64-bit keys of the windows at these words, from prefix sums of names times powers."""
    out = np.empty((len(at), 2), np.uint64)
    for k, (factor, inverse) in enumerate(zip(_FACTORS, _INVERSES)):
        powers = np.cumprod(np.append(np.uint64(1), np.full(len(names), factor, np.uint64)))
        back = np.cumprod(np.append(np.uint64(1), np.full(len(names), inverse, np.uint64)))
        own = mixed(names ^ (_LEFT, _RIGHT)[k])
        sums = np.append(np.uint64(0), np.cumsum(own * powers[:-1]))
        out[:, k] = mixed((sums[at + window] - sums[at]) * back[at])
    return out


def fits(ordinals: np.ndarray, reach: np.ndarray) -> bool:
    """Whether the shared names at these sorted places hold all that some window needs."""
    if not len(ordinals):
        return False
    breaks = np.flatnonzero(np.diff(ordinals) != 1)
    ends = ordinals[np.append(breaks, len(ordinals) - 1)] + 1
    end = np.repeat(ends, np.diff(np.concatenate([[0], breaks + 1, [len(ordinals)]])))
    return bool((reach <= end).any())


def _blocks(batches: Iterator, text_column: int, words_at_once: int = 1 << 20) -> Iterator[tuple[list[int], list[list[bytes]], object]]:
    """(rows, their words, batch) in blocks of about a million words, so that arrays stay small."""
    for batch in batches:
        rows, words, total = [], [], 0
        for row, text in enumerate(batch.column(text_column)):
            found = split_words(text.as_buffer().to_pybytes())
            rows.append(row)
            words.append(found)
            total += len(found)
            if total >= words_at_once:
                yield rows, words, batch
                rows, words, total = [], [], 0
        if rows:
            yield rows, words, batch


def joined_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


class _Block:
    """Texts of a block with the names their windows need.

    A window needs the names it determines, ``low[p]`` to ``high[p]``
    in order; one that determines none, as in one word said over and over,
    is open and needs its own key.
    """

    def __init__(self, words: list[list[bytes]], window: int, rounds: int) -> None:
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = word_names([w for found in words for w in found])
        parse = Parse(self.words, self.sizes, rounds)
        self.names = parse.names
        #: the names before each text
        self.first = np.searchsorted(parse.at, np.append(self.starts, len(self.words)))
        self.at = window_starts(self.sizes, window)
        self.text = np.searchsorted(np.cumsum(self.sizes), self.at, side="right")
        self.low = parse.left[self.at]
        self.high = np.maximum(parse.right[self.at + window], self.low)
        self.open = np.flatnonzero(self.high == self.low)
        self.open_text = self.text[self.open]
        self.open_keys = window_keys(self.words, self.at[self.open], window)[:, 0] if len(self.open) else np.zeros(0, np.uint64)

    def open_of(self, text: int) -> tuple[np.ndarray, np.ndarray]:
        """The open windows of a text and their keys."""
        a, b = np.searchsorted(self.open_text, [text, text + 1])
        return self.open[a:b], self.open_keys[a:b]


def named_texts(texts: DataFrame, window: int, rounds: int) -> DataFrame:
    """(doc_id, digest, n_words, all_sha256, names, spans) of (doc_id, digest, text).

    ``names`` are the names of the last level in order, then the distinct keys
    of open windows; ``spans`` says for each how many names from it on the
    shortest window beginning with it needs.
    """
    kinds = "doc_id long, digest binary, n_words long, all_sha256 string, names array<long>, spans array<int>"

    def parsed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows, words, batch in _blocks(batches, 2):
            block = _Block(words, window, rounds)
            near = np.full(len(block.names) + 1, _NEVER, np.int64)
            held = block.high > block.low
            np.minimum.at(near, block.low[held], block.high[held])
            names, spans = [], []
            for k, size in enumerate(block.sizes):
                if size < window:
                    names.append([])
                    spans.append([])
                    continue
                lo, hi = block.first[k], block.first[k + 1]
                own = np.unique(block.open_of(k)[1])
                needed = np.where(near[lo:hi] < _NEVER, near[lo:hi] - np.arange(lo, hi), _NEVER)
                names.append(np.append(block.names[lo:hi], own).astype(np.int64))
                spans.append(np.append(needed, np.ones(len(own), np.int64)).astype(np.int32))
            columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)]
            columns += [pa.array(block.sizes, pa.int64()), pa.array([joined_digest(w) for w in words], pa.string())]
            columns += [pa.array(names, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in kinds.split(", ")])

    return texts.select("doc_id", "digest", "text").mapInArrow(parsed, kinds)


def shared_names(parsed: DataFrame) -> DataFrame:
    """(row, ordinals) of the texts with a window whose names all stand in two rows or more."""
    names = parsed.select("row", F.posexplode(F.arrays_zip("names", "spans")).alias("ordinal", "cell"))
    # place and span travel as one number
    names = names.select("row", F.col("cell.names").alias("name"), (F.shiftleft(F.col("ordinal").cast("long"), 32) + F.col("cell.spans")).alias("cell"))
    # a name of one text only can be in no window that another has
    sums = names.groupBy("name").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count(F.lit(1)).alias("size"))
    shared = written(sums.filter("low < high").select("name", "size"), "shared-names")
    total = shared.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    held = join_groups(names, shared, "name", "size", total).select("row", "cell")
    # bounded by the names of one text
    marks = held.groupBy("row").agg(F.sort_array(F.collect_list("cell")).alias("cells"))

    def chosen(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cells = [c.values.to_numpy() for c in batch.column(1)]
            keep = [fits(c >> 32, (c >> 32) + (c & _NEVER)) for c in cells]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([(c >> 32).astype(np.int32) for c in cells], pa.list_(pa.int32()))], names=["row", "ordinals"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return marks.mapInArrow(chosen, "row long, ordinals array<int>")


def _candidates(touched: DataFrame, window: int, rounds: int) -> DataFrame:
    """(key, doc_id, row) of the distinct windows of (doc_id, row, text, ordinals) all of whose names are shared."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows, words, batch in _blocks(batches, 2):
            block = _Block(words, window, rounds)
            shared = np.zeros(len(block.names), bool)
            chosen = np.zeros(len(block.at), bool)
            for k, row in enumerate(rows):
                lo, hi = block.first[k], block.first[k + 1]
                places = batch.column(3)[row].values.to_numpy()
                shared[lo + places[places < hi - lo]] = True
                at, keys = block.open_of(k)
                chosen[at] = np.isin(keys, np.unique(keys)[places[places >= hi - lo] - (hi - lo)])
            alone = np.append(0, np.cumsum(~shared))
            chosen |= (block.high > block.low) & (alone[block.high] == alone[block.low])
            keys = window_keys(block.words, block.at[chosen], window)
            text, keys = block.text[chosen], keys.view([("", np.uint64)] * 2).ravel()
            # a window is told once for its text
            _, once = np.unique(np.rec.fromarrays([text, keys["f0"], keys["f1"]]), return_index=True) if len(keys) else (None, np.zeros(0, np.int64))
            columns = [key_bytes(keys[once]), *(batch.column(c).take(pa.array(np.array(rows, np.int64)[text[once]])) for c in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "row"])

    return touched.select("doc_id", "row", "text", "ordinals").mapInArrow(cut, "key binary, doc_id long, row long")


def key_bytes(keys: np.ndarray):
    """Pairs of 64-bit keys as 12 bytes each."""
    import pyarrow as pa

    raw = np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), 16)[:, :KEY_BYTES]
    return pa.Array.from_buffers(pa.binary(KEY_BYTES), len(keys), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _cut(touched: DataFrame, window: int) -> DataFrame:
    """(row, doc_id, n_removed, kept_sha256, kept) of (row, doc_id, text, gone): the words outside the windows with these keys."""

    def removed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            gone, sha, kept = [], [], []
            for text, keys in zip(batch.column(2), batch.column(3)):
                words = split_words(text.as_buffer().to_pybytes())
                own = window_keys(word_names(words), np.arange(len(words) - window + 1), window)
                own = np.frombuffer(own.tobytes(), np.uint8).reshape(-1, 16)[:, :KEY_BYTES].tobytes()
                asked = set(keys.values.to_pylist())
                at = np.array([p for p in range(len(words) - window + 1) if own[KEY_BYTES * p : KEY_BYTES * (p + 1)] in asked], np.int64)
                steps = np.zeros(len(words) + 1, np.int64)
                steps[at] += 1
                steps[at + window] -= 1
                stay = np.cumsum(steps[:-1]) == 0
                left = [w for w, s in zip(words, stay) if s]
                gone.append(len(words) - len(left))
                sha.append(joined_digest(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=names)

    names = ["row", "doc_id", "n_removed", "kept_sha256", "kept"]
    return touched.select("row", "doc_id", "text", "gone").mapInArrow(removed, "row long, doc_id long, n_removed long, kept_sha256 string, kept binary")


def repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, n_words, n_removed, kept_sha256) of every row, and (doc_id, kept) of the texts cut in part.

    A window is ``window`` words in a row. A word goes when a window over it
    has the words of a window that starts in a document with a smaller id.

    Texts are compressed for some levels by names that depend on the words
    alone. Equal texts are folded: all but those with the smallest id lose all
    their words if they hold a window at all. Of the others a global count
    finds the names that several texts have, and only windows made of such
    names are keyed by 96 bits and compared. No window that occurs in two
    documents is lost: its names occur in both.

    Null and empty texts have no words. Null ids are neither smaller nor
    larger than others: their rows keep all words and take none. Rows that share
    an id take nothing from each other. An empty table gives no rows; other
    columns are ignored.
    """
    rounds = rounds_for(window)
    text = whole_text(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"))
    columns = ["doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "text"]
    parsed = written(named_texts(texts.select(*columns), window, rounds).withColumn("row", F.monotonically_increasing_id()), "parsed")
    n_rows = parsed.count()
    light = parsed.select("row", "doc_id", "digest", "n_words", "all_sha256")
    groups = written(light.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size")), "groups")
    folded = written(join_groups(light, groups, "digest", "size", n_rows), "folded")
    # of equal texts those with the smallest id go on
    copies = folded.filter("not doc_id <=> first or doc_id is null").select("row")
    marks = written(shared_names(parsed.select("row", "names", "spans").join(copies, "row", "left_anti")), "marks")
    asked = folded.select("row", "doc_id", "digest").join(marks, "row")
    few = possible(texts, asked, "doc_id", n_rows).select(*columns).dropDuplicates(["doc_id", "digest"])
    touched = written(few.join(asked, ["doc_id", "digest"]).drop("digest"), "touched", "zstd")
    windows = written(_candidates(touched, window, rounds), "windows")
    sums = windows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("size"))
    again = written(sums.filter("low < high").drop("high"), "again")
    total = again.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    later = join_groups(windows, again, "key", "size", total).filter("doc_id > low")
    # bounded by the windows of one text
    gone = written(later.groupBy("row").agg(F.collect_list("key").alias("gone")), "gone")
    # few texts are cut, so their numbers pick them before texts are dealt
    hit = written(gone.select("row"), "hit")
    cut = written(_cut(touched.drop("ordinals").join(hit, "row", "left_semi").join(gone, "row"), window), "cut")
    every = folded.join(cut.select("row", "n_removed", "kept_sha256"), "row", "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window)
    found = every.select(
        F.col("doc_id").alias(id_col), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    )
    return found, cut.select(F.col("doc_id").alias(id_col), "kept")
