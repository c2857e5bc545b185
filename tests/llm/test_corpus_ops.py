"""Resampling, fill-in-the-middle and repeated passages against plain versions."""

import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import fillmiddle, resample
from panelyard.llm.recompression import Parse, repeats, rounds_for, split_words, window_keys, word_names

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{k}" for k in range(60_000))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# resampling


def brute_features(text, words):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(found), [" ".join(found[i : i + k]) for k in range(1, words + 1) for i in range(len(found) - k + 1)]


def brute_resample(rows, target, share, least, words, buckets):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in brute_features(t, words)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts([x for _, x in rows]), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    found = []
    for i, text in rows:
        n, runs = brute_features(text, words)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in runs)
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        found.append((i, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    fit = sorted((f for f in found if f[4] >= least), key=lambda f: (-f[3], f[0] is None, f[0] or 0))
    chosen = fit[: share * len(fit) // 100]
    ranked = [(*f[:4], k) for k, f in enumerate(chosen, 1)]
    left = list(found)
    for f in chosen:
        left.remove(f)
    return sorted(ranked + [(*f[:4], None) for f in left], key=repr)


@pytest.mark.parametrize("words,share,least", [(1, 10, 3), (2, 55, 1), (1, 100, 0), (1, 0, 0)])
def test_resample_equals_plain_version(spark, docs, words, share, least):
    pick = random.Random(words + share)
    rows = [(i, " ".join(pick.choices(["Sum", "of", "übung", "9x", "tree's", "--", "river"], k=pick.randint(0, 30)))) for i in range(300)]
    rows += [(7, None), (8, ""), (None, "sum of river tree"), (9, "sum of 9x"), (9, "sum of 9x"), (500, LONG)]
    target = ["the SUM of 9x", None, "", "river"]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, score int")
    got = resample.resample(docs(rows, True), goal, share=share, least=least, words=words, buckets=97)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(rows, target, share, least, words, 97)


def test_resample_of_nothing(spark, docs):
    empty = docs([])
    assert resample.resample(empty, docs([(1, "a")])).collect() == []
    got = resample.resample(docs([(1, "a b")]), empty, share=100, least=1).collect()
    assert [r["rank"] for r in got] == [1]


def scores(spark, values):
    return spark.createDataFrame([(i, 30, 1, v, v) for i, v in enumerate(values)], "doc_id long, n_words long, n_features long, weight long, score long")


def test_bracket_widens_until_counts_prove_it(spark):
    rows = scores(spark, list(range(5000)))
    for wanted in (1, 2, 499, 2500, 4999, 5000):
        low, high, above = resample.bracket(rows, wanted, 5000, error=0.0005)
        value = 5000 - wanted
        assert low <= value <= high and above == 4999 - high
    # nearly all scores are one value: the draw ends inside a tie
    tied = scores(spark, [5] * 3000 + [9] * 10 + [1] * 10)
    low, high, above = resample.bracket(tied, 300, 3020)
    assert low <= 5 <= high and above < 300
    drawn = [tuple(r) for r in resample.draw(tied, 1, 10).select("rank", "doc_id", "score").filter("rank is not null").orderBy("rank").collect()]
    assert drawn == [(k, 2999 + k, 9) for k in range(1, 11)] + [(k, k - 11, 5) for k in range(11, 303)]


# fill in the middle


def brute_fim(doc_id, text, rate=100, share=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (doc_id, len(units), "plain", None, None), text
    form = "spm" if h4 % 100 < share else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(units), form, len(p), len(m)), out


FIM_ROWS = [(1, None), (2, ""), (3, "\n"), (4, "one"), (5, "a\nb\nc\n"), (6, "ü\n漢字\nend"), (7, "has <S> inside\nx\n"), (None, "x\ny\nz"), (5, "a\nb\nc\n"), (5, "other\ntext"), (8, "<\nP>\n<"), (9, "é" * 70_000 + "\n" + LONG.replace("w9", "\n"))]


@pytest.mark.parametrize("rate,share,chunk", [(100, 50, 1 << 16), (60, 0, 7), (100, 100, 4096)])
def test_fill_in_middle_equals_plain_version(docs, rate, share, chunk):
    rows = FIM_ROWS[: -1 if chunk < 100 else None] + [(i, "".join(random.Random(i).choices("ab<SPM>\n ß", k=i))) for i in range(20, 90)]
    got = fillmiddle.fill_in_middle(docs(rows, True), rate, share, chunk=chunk).collect()
    want = []
    for i, t in rows:
        meta, out = brute_fim(i, t, rate, share)
        assert fillmiddle.restore(out, meta[2]) == (t or "")
        want.append((*meta, sha(out), sha(t or "")))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_outputs_as_texts(docs):
    pieces = fillmiddle.fim_pieces(docs(FIM_ROWS), chunk=1000)
    assert pieces.agg(F.max(F.length("chunk"))).first()[0] <= 1003
    got = sorted(map(tuple, fillmiddle.fim_texts(pieces).collect()), key=repr)
    assert got == sorted(((*m, out) for m, out in (brute_fim(i, t) for i, t in FIM_ROWS)), key=repr)
    assert fillmiddle.fill_in_middle(docs([])).collect() == []


# repeated passages


def brute_repeats(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), ws in zip(rows, words):
        for p in range(len(ws) - window + 1) if i is not None else ():
            key = tuple(ws[p : p + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for (i, _), ws in zip(rows, words):
        gone = set()
        for p in range(len(ws) - window + 1) if i is not None else ():
            if first[tuple(ws[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(ws), len(gone), sha(" ".join(w for k, w in enumerate(ws) if k not in gone))))
    return sorted(out, key=repr)


def test_equal_windows_determine_equal_names():
    pick = random.Random(5)
    for window in (5, 20, 50):
        texts = [" ".join(pick.choices("ab" if k % 3 else "abcdefgh", k=pick.randint(0, 90))) for k in range(30)] + ["a " * 70, "a b " * 50, "a b c a " * 40]
        texts += [" ".join((texts[0] + " " + texts[k]).split()[-80:]) for k in range(9)]
        words = [split_words(t.encode()) for t in texts]
        sizes = np.array([len(w) for w in words])
        names = word_names([w for ws in words for w in ws])
        parse = Parse(names, sizes, rounds_for(window))
        found, keys, at = {}, {}, 0
        for ws in words:
            for p in range(len(ws) - window + 1):
                left, right = parse.left[at + p], parse.right[at + p + window]
                own = tuple(parse.names[left:right]) if left < right else ()
                text = tuple(ws[p : p + window])
                assert found.setdefault(text, own) == own
                key = bytes(window_keys(names, np.array([at + p]), window)[0])
                assert keys.setdefault(key, text) == text
            at += len(ws)
        assert len(keys) == len(found)


@pytest.mark.parametrize("window", [2, 4, 9, 50])
def test_repeats_equal_plain_version(docs, window):
    pick = random.Random(window)
    words = [f"w{k}" for k in range(3 if window < 9 else 400)]
    shared = [" ".join(pick.choices(words, k=window + k)) for k in range(4)]
    rows = []
    for i in range(60):
        own = pick.choices(words, k=pick.randint(0, 3 * window))
        cut = pick.randint(0, len(own))
        rows.append((i * 7 % 60, " ".join([*own[:cut], *([pick.choice(shared)] if i % 2 else []), *own[cut:]])))
    rows += [(100 + k, "hot  text\t" + shared[0]) for k in range(30)] + [(200, "a " * (2 * window)), (201, "a\n" * (3 * window)), (202, "A " * (2 * window)), (203, "x y " * window)]
    rows += [(204, "y x " * window + "end"), (205, None), (206, ""), (207, " \t\n"), (None, shared[1]), (None, shared[0] + " tail"), (3, shared[2]), (3, shared[2] + " " + shared[3]), (3, shared[2])]
    got, cut = repeats(docs(rows, True), window)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == brute_repeats(rows, window)
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in cut.collect()}
    sums = {r[0]: r[3] for r in brute_repeats(rows, window)}
    assert kept and all(sha(t) == sums[i] for i, t in kept.items() if i != 3)


def test_repeats_in_long_texts_and_none(docs):
    rows = [(1, LONG), (2, "start " + LONG[100_000:]), (5, None), (3, "q " * 40_000), (4, "q " * 50_000)]
    got, _ = repeats(docs(rows))
    assert sorted(tuple(r) for r in got.collect()) == brute_repeats(rows, 50)
    got, cut = repeats(docs([]))
    assert got.collect() == [] and cut.collect() == []


def test_texts_of_shared_phrases_only_are_not_dealt(spark, docs):
    pick = random.Random(3)
    phrases = [" ".join(f"w{pick.randrange(5000)}" for _ in range(4)) for _ in range(500)]
    rows = [(i, " ".join(pick.choices(phrases, k=50))) for i in range(150)]
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(root.glob("touched-*"))
    got, _ = repeats(docs(rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_repeats(rows, 50)
    (touched,) = set(root.glob("touched-*")) - before
    # no window stands in two texts
    assert not any(r[2] for r in brute_repeats(rows, 50))
    assert spark.read.parquet(str(touched)).count() <= 30


def test_possible_keeps_every_key_and_few_others(spark):
    from panelyard.llm.common import possible

    rows = spark.range(-20_000, 20_000).withColumn("note", F.lit("x")).unionAll(spark.sql("SELECT cast(null AS long), 'none'"))
    keys = spark.range(-20_000, 20_000, 7).unionAll(spark.sql("SELECT cast(null AS long)"))
    got = [r[0] for r in possible(rows, keys, "id", 40_001).select("id").collect()]
    assert len(got) == len(set(got)) and set(got) >= set(range(-20_000, 20_000, 7)) and len(got) < 10_000
    assert possible(rows, keys.limit(0), "id", 40_001).collect() == []
