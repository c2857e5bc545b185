"""Copies, near copies and shards against brute force."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from panelyard.llm.exactdedup import CuckooFilter, LiveIndex, delete_digests, digests, drop_copies, exact_groups, insert_digests, partial
from panelyard.llm.minhash import drop_near_copies, near_groups
from panelyard.llm.sharding import shard_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_cuckoo_filter_holds_moves_and_forgets():
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    held, count = CuckooFilter(100), 0
    for n, key in enumerate(keys, 1):
        if not held.insert(key):
            held = held.resized(keys[:n])
            count += 1
    assert count and all(k in held for k in keys)
    for key in keys[:2000]:
        held.delete(key)
    assert all(k in held for k in keys[2000:])
    assert sum(k in held for k in keys[:2000]) < 40


def test_index_counts_and_deletes():
    index = LiveIndex()
    a, b = (hashlib.sha256(x).digest() for x in (b"a", b"b"))
    index.insert(a, 5, 2)
    index.insert(a, 3, 1)
    index.insert(b, 9, 1)
    index.delete(hashlib.sha256(b"c").digest(), 1)
    assert index.content == {a: [5, 3], b: [9, 1]}
    index.delete(a, 3)
    assert a not in index.filter and index.content == {b: [9, 1]}


ROWS = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "ÄB"), (6, "äb"), (7, "äB"), (8, "x" * 200_000), (9, "X" * 200_000), (2, "same text"), (None, "no id"), (None, "SAME TEXT")]


def brute_groups(rows):
    normal = lambda t: (t or "").translate(LOWER)
    out = []
    for i, t in rows:
        ids = [j for j, u in rows if normal(u) == normal(t)]
        keep = max((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups(docs):
    got = exact_groups(docs(ROWS, True)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_groups(ROWS)
    assert exact_groups(docs([])).collect() == []


def test_exact_groups_with_a_hot_text(docs):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 500}") for i in range(3000)]
    got = exact_groups(docs(rows)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    size = {}
    for i, t in rows:
        size.setdefault(t, []).append(i)
    want = sorted((i, max(size[t]), len(size[t]), i == max(size[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted(map(tuple, got.collect())) == want


def test_copies_meet_in_the_index_only(docs, monkeypatch):
    """Equal digests reach a bucket as several rows; a filter that never hits would split their group."""
    rows = docs([(i, "copied" if i % 2 else f"own {i}") for i in range(400)]).repartition(8)
    sent = partial(digests(rows), 4)
    assert sent.count() > 201 and sent.agg(F.sum("group_size")).first()[0] == 400
    held = insert_digests(digests(rows), 4).filter("group_size > 1").collect()
    assert [(r["keep_id"], r["group_size"]) for r in held] == [(399, 200)]
    key = hashlib.sha256(b"copied").digest()
    index = LiveIndex()
    for i in range(3):
        index.insert(key, i, 10)
    assert index.content == {key: [2, 30]}
    monkeypatch.setattr(CuckooFilter, "__contains__", lambda self, digest: False)
    blind = LiveIndex()
    for i in range(3):
        blind.insert(key, i, 10)
    assert blind.content != index.content


def test_index_over_batches(docs):
    first, second = digests(docs([(1, "a"), (2, "b"), (3, "A")])), digests(docs([(9, "a"), (4, "c")]))
    held = insert_digests(second, 4, insert_digests(first, 4))
    assert sorted((r["keep_id"], r["group_size"]) for r in held.collect()) == [(2, 1), (4, 1), (9, 3)]
    left = delete_digests(digests(docs([(2, "b"), (1, "a")])), 4, held)
    assert sorted((r["keep_id"], r["group_size"]) for r in left.collect()) == [(4, 1), (9, 2)]


def test_drop_copies_keeps_columns_and_one_of_each(docs):
    rows = docs(ROWS, True)
    got = drop_copies(rows)
    assert got.columns == rows.columns
    assert sorted(((r["doc_id"], r["text"][:5] if r["text"] else r["text"]) for r in got.collect()), key=repr) == sorted(
        [(2, "same "), (4, ""), (5, "ÄB"), (7, "äB"), (9, "XXXXX"), (None, "no id")], key=repr
    )


def sets_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def brute_near(rows, width, percent=80):
    sets = {i: sets_of(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


@pytest.mark.parametrize("width", [4, 5])
def test_near_groups_on_edited_families(docs, width):
    rng = random.Random(width)
    words = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 120, 400]))]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((i, (" " if rng.random() < 0.5 else "\n").join(text).upper() if rng.random() < 0.3 else " ".join(text)))
            i += 1
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "one two"), (1005, " \t "), (1006, "z " * 30_000)]
    got = near_groups(docs(rows, True), width).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == brute_near(rows, width)


def test_near_groups_of_nothing_and_repeats(docs):
    assert near_groups(docs([])).collect() == []
    got = near_groups(docs([(2, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (None, "q r s t u v")]))
    assert sorted(map(tuple, got.select("doc_id", "component_id", "kept").collect()), key=repr) == sorted([(2, 1, False), (1, 1, True), (1, 1, True), (None, None, True)], key=repr)


def test_near_groups_of_an_id_with_several_texts(docs):
    """Texts of one id link by themselves, in whatever order the rows come."""
    base = [f"w{k}" for k in range(80)]
    near, other = " ".join([*base[:-1], "end"]), " ".join(f"o{k}" for k in range(80))
    rows = [(1, other), (1, " ".join(base)), (2, near), (3, other + " more"), (4, near + " x")]
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False)]
    for order in (rows, [rows[1], rows[0], *rows[2:]], rows[::-1]):
        assert sorted(tuple(r) for r in near_groups(docs(order)).select("doc_id", "component_id", "kept").collect()) == want


def test_drop_near_copies(docs):
    rows = docs([(2, "a b c d e f"), (1, "A b c d e f"), (5, "something else that stays here"), (6, None), (7, "")], True)
    got = drop_near_copies(rows)
    assert got.columns == rows.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 5, 6, 7]


@pytest.mark.parametrize("rows", [
    [(i, "hot" if i % 3 == 0 else f"t{i % 60}" if i % 3 == 1 else f"alone {i}") for i in range(1000)],
    [(i, "all the same") for i in range(101)],
    [(i, f"pair {i // 2}") for i in range(64)],
    [(1, None), (2, ""), (None, "x"), (3, "y"), (3, "y")],
])
def test_shards(docs, rows):
    got = shard_documents(docs(rows, True), 8).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 1) for i, t in rows), key=repr)
    shards = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)}
    assert all(slots == list(range(len(slots))) for slots in shards.values())
    counts = [len(s) for s in shards.values()]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    if rows[0][1] == "pair 0":  # all shards are full, so pairs can only meet by exchange; 59 parts before
        text = dict(rows)
        assert len({(text[r["doc_id"]], r["shard"]) for r in got}) <= 48
    assert shard_documents(docs([]), 8).collect() == []


def test_hot_group_touches_few_shards(docs):
    rows = [(i, "hot" if i % 2 == 0 else f"alone {i}") for i in range(800)]
    got = shard_documents(docs(rows), 8).collect()
    # half of all rows need four shards of eight
    assert len({r["shard"] for r in got if r["doc_id"] % 2 == 0}) <= 5
