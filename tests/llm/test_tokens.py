"""Token counts, token files and packing against the libraries."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm.common import IdEncoder, tokenizer_path, written
from panelyard.llm.packing import best_fit, cut_pieces, pack, place_pieces
from panelyard.llm.tokencount import WholeTokens, count_tokens
from panelyard.llm.tokenfiles import read_token_files, token_spans, write_token_files

PARTS = [
    "a", "B", "é", "ß", "İ", "Σ", "ς", "1", "²", "½", "٣", ".", ",", "!", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ",
    "　", "<|endoftext|>", "<|startoftext|>", "<s>", "é", "́", "𝔸", "日本", "😀", "#", "$$$", "word", "The", "x​y", "▁", "\x00",
]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    encoder = IdEncoder(tokenizer_path(name))
    assert encoder.ids is not None  # the fast way is in use
    for text in [*odd_texts(4000), "", "x" * 3000, "word " * 3000]:
        want = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.encode(text) == want, text


def test_encoder_merges_a_unit_once():
    encoder = IdEncoder(tokenizer_path("word_bpe_49k.json"))
    asked, merged = [], encoder.units.merged
    encoder.units.merged = lambda unit: asked.append(unit) or merged(unit)
    rng = random.Random(5)
    parts = [*PARTS, "\x1d", "\x1f", "\u1680", "\u2028", "\u0301", "\u0345", "\u1100\u1161", "y" * 60]
    for text in ["The cat's 12 mats,\tThe cat's", *["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(4000)]]:
        want = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.encode(text) == want, text
    short = [unit for unit in asked if len(unit) <= 48]
    assert short[:4] == ["The", "cat's", "12", "mats,"] and len(short) == len(set(short))


def test_whole_tokens_equal_library():
    counter = WholeTokens(tokenizer_path("piece_bpe_32k.model"))
    assert counter.separate and len(counter.proven) > 10_000
    for text in [*odd_texts(4000), "", " ", "   ", "a ", " a", "y" * 3000]:
        assert counter.count(text) == len(counter.library.encode(text)), text


ROWS = [(1, "The cat sat on the mat."), (2, None), (3, ""), (4, "The cat sat on the mat."), (None, "no id"), (5, "word " * 5000), (1, "again"), (6, "\n\t  ")]


def test_token_counts(docs):
    path = tokenizer_path("piece_bpe_32k.model")
    library = WholeTokens(path).library
    got = sorted(map(tuple, count_tokens(docs(ROWS, True), path).collect()), key=repr)
    assert got == sorted([(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in ROWS], key=repr)
    assert count_tokens(docs([]), path).collect() == []


def test_token_files_round_trip(spark, docs, tmp_path):
    name = tokenizer_path("word_bpe_49k.json")
    rows = [(i, t) for i, t in enumerate(odd_texts(300))] + [(500, None), (501, "word " * 5000), (7, "twice"), (None, "no id")]
    path = str(tmp_path / "ids")
    write_token_files(docs(rows, True).repartition(5), path, name, end_id=2)
    library = IdEncoder(name).tokenizer
    ids = {}
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids[i] = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids[i]), zlib.crc32(np.array(ids[i], dtype="<u4").tobytes())))
        start += len(ids[i])
    assert sorted(map(tuple, token_spans(spark, path).collect()), key=repr) == sorted(want, key=repr)
    one = read_token_files(spark, path).filter("doc_id = 501")
    assert one.collect()[0]["ids"] == ids[501]
    assert "EqualTo(doc_id,501)" in one._jdf.queryExecution().executedPlan().toString()


def test_token_files_of_nothing(spark, docs, tmp_path):
    path = str(tmp_path / "none")
    write_token_files(docs([]), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    assert token_spans(spark, path).collect() == []


def sequential_best_fit(lengths, capacity):
    """Piece by piece: the tightest open window, else a new one."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, x in enumerate(left) if x >= n]
        if fits:
            k = min(fits, key=lambda k: left[k])
            left[k] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_equals_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 10, 16, 31])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    windows, ranks = {}, {}
    for length, rank, n, sequence, offset in best_fit(counts, capacity):
        for k in range(n):
            windows.setdefault(sequence + k, []).append((offset, length))
            ranks.setdefault(length, []).append(rank + k)
    for length, n in counts.items():
        assert sorted(ranks[length]) == list(range(n))
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(windows) == list(range(len(windows)))
    assert sorted(capacity - sum(n for _, n in held) for held in windows.values()) == sequential_best_fit(lengths, capacity)


def test_packing_keeps_every_id(docs):
    name = tokenizer_path("byte_bpe_50k.json")
    rows = [(i, t) for i, t in enumerate(odd_texts(200))] + [(900, None), (901, "word " * 9000), (902, "same"), (902, "same"), (903, "same")]
    got = pack(docs(rows, True), name, capacity=64).collect()
    library = IdEncoder(name).tokenizer
    whole = {}
    for r in got:
        whole.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
        assert len(r["ids"]) == 4 * r["length"]
    for i, t in rows:
        want = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()
        held = b"".join(p for _, p in sorted(whole[i]))
        assert held == want * (2 if i == 902 else 1)
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(windows) == list(range(len(windows)))
    assert pack(docs([]), name).collect() == []


def test_packing_with_one_common_length(spark):
    pieces = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 100).otherwise(F.col("id") % 37 + 1).cast("long").alias("length"))
    placed = place_pieces(written(pieces, "pieces"), capacity=128)
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert used.filter("n != end or n > 128").count() == 0
    assert placed.count() == 20_000 and placed.select("sequence_id", "offset").distinct().count() == 20_000


def test_too_long_pieces_are_refused(spark, docs):
    with pytest.raises(ValueError):
        place_pieces(cut_pieces(docs([(1, "word " * 100)]), tokenizer_path("byte_bpe_50k.json"), capacity=64), capacity=32)
