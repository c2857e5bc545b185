"""Column helpers, gapless numbering and tokenizer helpers shared by the operators."""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.session import parallelism, scratch_path

#: Units a worker keeps, and the longest one worth keeping.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48


def whole_text(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of 8 MB for Python workers: long texts would else fill buffers outside the heap."""
    before = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, str(8 << 20))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_BYTES)
        else:
            spark.conf.set(_BATCH_BYTES, before)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet below spark.checkpoint.dir and read again: lineage ends, sizes are known to the planner."""
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.parquet(path)


def slices(spark: SparkSession) -> int:
    """Parts into which the rows of one key are dealt."""
    return max(64, 8 * parallelism(spark))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """A gapless number from 0 within ``keys``, also where one key holds most rows.

    Rows of a key are dealt to slices by the hash of ``order``; a row's number
    is its place in its slice plus the rows of the slices before it. Rows that
    agree in ``order`` share a slice and take neighbouring numbers. ``keys`` are
    never null.
    """
    n = slices(df.sparkSession)
    part = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(n)))
    cell = [*keys, "_slice"]
    sums = part.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*cell, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    placed = part.withColumn("_within", within).join(sums, cell, "left")
    return placed.select(*df.columns, (F.col("_before") + F.col("_within") - 1).alias(out))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, missing: bool = False) -> DataFrame:
    """``rows`` with the columns of their group; with ``missing``, the rows that have no group, without those columns.

    ``groups`` has one row per key and its rows in ``size``. The groups of more
    than 1/200 of all rows, 200 at most, meet their rows without a shuffle, so
    that no join partition holds a hot group.
    """
    large = F.col(size) > max(100, total // 200)
    hot = F.broadcast(groups.filter(large).withColumn("_hot", F.lit(True)))
    met = rows.join(hot, key, "left")
    rest = met.filter("_hot is null").select(*rows.columns)
    if missing:
        return rest.join(groups.select(key), key, "left_anti")
    columns = [*rows.columns, *[c for c in groups.columns if c != key]]
    return met.filter("_hot is not null").select(*columns).unionByName(rest.join(groups.filter(~large), key).select(*columns))


#: Bits of a map for each row of a table and in all (64 MB), and bits in one piece of it.
_BITS_PER_ROW, _MOST_BITS, _PIECE_BITS = 4, 1 << 29, 1 << 15


def possible(rows: DataFrame, keys: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``keys``; none that has one is lost.

    The keys are bits of a map by their hash. The map is small, so that rows
    drop out before they are dealt; an exact join is to follow. ``n_rows`` sizes
    the map. Rows with a null key drop out.
    """
    bits = min(_MOST_BITS, max(_PIECE_BITS, _BITS_PER_ROW * n_rows))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    piece, bit = (place / _PIECE_BITS).cast("int"), (place % _PIECE_BITS).cast("long")
    held = keys.filter(F.col(key).isNotNull()).select(piece.alias("_piece"), bit.alias("_bit"))
    maps = held.groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    met = rows.withColumns({"_piece": piece, "_bit": bit}).filter(F.col(key).isNotNull()).join(F.broadcast(maps), "_piece")
    byte = F.conv(F.hex(F.substring("_map", (F.col("_bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return met.filter(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*rows.columns)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space in the sense of Unicode's White_Space.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_SEPARATORS = re.compile("[\x1c-\x1f]")

#: The split of byte-level vocabularies, and that of vocabularies with word ends (fixed values).
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_END_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _symbols() -> dict[str, int]:
    """The visible sign of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class _Units(dict):
    """Unit of a text between white space -> its ids as bytes; at most ``CACHE_ENTRIES``, none longer than ``CACHE_CHARS``."""

    def __init__(self, merged) -> None:
        super().__init__()
        self.merged = merged

    def __missing__(self, unit: str) -> bytes:
        ids = self.merged(unit)
        if len(unit) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[unit] = ids
        return ids


class IdEncoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes, as the tokenizers library gives them.

    Two kinds of vocabulary are run by tiktoken's merges, which are the same
    and several times faster: byte-level ones whose ids follow the order of
    merges, and ones with word ends, where a blank behind each word stands for
    the end sign and merges first. In the latter no word crosses white space,
    so a text's ids are those of its units between white space, and the ids of
    short units are kept. Texts with special strings, and all other
    vocabularies, go through the library.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ids, self.prepare, self.units = None, str, None
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("continuing_subword_prefix"):
            return
        end, kind = model.get("end_of_word_suffix"), [(spec["normalizer"] or {}).get("type"), pre.get("type")]
        if not end and kind == [None, "ByteLevel"] and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self._fast(model, "", BYTE_LEVEL_SPLIT)
        elif end and kind == ["Sequence", "Sequence"]:
            rules = [n.get("type") for n in spec["normalizer"]["normalizers"]]
            splits = [p.get("pattern", {}).get("Regex") for p in pre["pretokenizers"]]
            if rules == ["NFC", "Replace", "Lowercase"] and splits == [WORD_END_SPLIT, None]:
                import regex

                self._fast(model, end, "[^ ]+ ")
                words = regex.compile(WORD_END_SPLIT)
                # a capital sigma lower-cases by itself, not by its place in the word
                self.prepare = lambda text: " ".join(words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())) + " "
                if self.ids is not None:
                    self.units = _Units(self._unit)

    def _fast(self, model: dict, end: str, split: str) -> None:
        import tiktoken

        sign = _symbols()

        def raw(token: str) -> bytes:
            tail = b" " if end and token.endswith(end) else b""
            return bytes(sign[c] for c in (token[: -len(end)] if tail else token)) + tail

        special = set(self.special)
        ranks = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"].get("".join(m)) for m in merges]
        singles = max(ranks[bytes([b])] for b in range(256) if bytes([b]) in ranks)
        ends = max((ranks.get(bytes([b, 32]), 0) for b in range(256) if b != 32), default=0) if end else singles
        # ids must rise with the merges, behind all single bytes and their word ends
        if None in order or order != sorted(order) or order[0] <= max(singles, ends) or any(bytes([b]) not in ranks for b in range(256)):
            return
        self.ids = tiktoken.Encoding("local", pat_str=split, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def tokenizer(self):
        """The library itself, loaded when a text needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        if self.ids is None or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        # str.split also parts at four control characters that are no white space to the library
        if self.units is not None and not _SEPARATORS.search(text):
            return b"".join(map(self.units.__getitem__, text.split()))
        return self._merged(text)

    def _unit(self, unit: str) -> bytes:
        plain = unit.isascii() and unit.isalpha()
        return array("I", self.ids.encode_ordinary(unit.lower() + " " if plain else self.prepare(unit))).tobytes()

    def _merged(self, text: str) -> bytes:
        return self.ids.encode_to_numpy(self.prepare(text), disallowed_special=()).astype("<u4").tobytes()


@functools.lru_cache(maxsize=4)
def id_encoder(path: str) -> IdEncoder:
    """The encoder of this worker."""
    return IdEncoder(path)
