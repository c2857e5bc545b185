import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions import similarity as S
from panelyard.operators import alike as A
from panelyard.operators import dedupe as U
from panelyard.operators import hotkeys
from panelyard.operators import overlap as V
from panelyard.operators import records as R

WORDS = "river land water dam eviction people county house town road farm goat".split()


def records(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(WORDS, k=rng.randint(1, 9)))
        if rows and rng.random() < 0.4:
            text = rng.choice(rows)[2]
            words = (text or "").split()
            rng.shuffle(words)
            text = " ".join(words) + rng.choice(["", "", " x", " yz"])
        start = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 120))
        end = rng.choice([None, start + dt.timedelta(days=rng.randint(-5, 90))])
        rows.append((i, rng.choice(["N", "K", None]), rng.choice([text, text, text, None, " "]), rng.choice([start, start, start, None]), end))
    return rows


def brute(rows, threshold=80.0, gap=30):
    out = set()
    for a in rows:
        for b in rows:
            if a[0] >= b[0] or a[1] is None or a[1] != b[1] or not (a[2] or "").strip() or not (b[2] or "").strip():
                continue
            if a[3] is None or b[3] is None or S.token_sort(a[2], b[2]) < threshold:
                continue
            overlap = a[4] is not None and b[4] is not None and a[3] <= b[4] and b[3] <= a[4]
            if overlap or abs((a[3] - b[3]).days) <= gap:
                out.add((a[0], b[0]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(hotkeys.spread_join, "__defaults__", (4,))  # make ordinary keys hot
    rows = records(120, seed)
    df = spark.createDataFrame(rows, "id int, county string, text string, s date, e date")
    args = ("id", "text", "county", "s", "e")
    member = {r["record"]: r["representative"] for r in U.copy_members(df, *args).collect()}
    by_rep = {}
    for record, rep in member.items():
        by_rep.setdefault(rep, []).append(record)
    got = {tuple(sorted((a, b))) for ms in by_rep.values() for a in ms for b in ms if a != b}
    report = U.near_duplicate_pairs(df, *args, source="county").collect()
    assert [r["similarity_score"] for r in report] == sorted((r["similarity_score"] for r in report), reverse=True)
    by_id = {r[0]: r for r in rows}
    for r in report:
        a, b = by_id[r["record_id_a"]], by_id[r["record_id_b"]]
        assert (r["text_a"], r["text_b"], r["source_a"], r["source_b"]) == (a[2], b[2], a[1], b[1])
        assert abs(S.token_sort(a[2], b[2]) - r["similarity_score"]) < 1e-9
        assert r["copies_a"] == len(by_rep[r["record_id_a"]]) and r["record_id_a"] < r["record_id_b"]
        got |= {tuple(sorted((a, b))) for a in by_rep[r["record_id_a"]] for b in by_rep[r["record_id_b"]]}
    assert got == brute(rows)


def jaccard(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("unknowns", [True, False])
def test_intake_matches_equal_brute_force(spark, unknowns, monkeypatch):
    monkeypatch.setattr(hotkeys.spread_join, "__defaults__", (5,))
    rng = random.Random(7)

    def make(n, base):
        out = []
        for i in range(n):
            text = " ".join(rng.choices(WORDS + [f"w{rng.randint(0, 30)}" for _ in range(6)], k=rng.randint(0, 10)))
            if out and rng.random() < 0.3:
                text = rng.choice(out)[1]
            county = rng.choice(["N", "K"] + (["", None] if unknowns else []))
            day = rng.choice([dt.date(2021, 1, 1) + dt.timedelta(days=rng.randint(0, 150))] + ([None] if unknowns else []))
            out.append((base + i, text, county, day))
        return out

    new, old = make(60, 0), make(25, 1000)
    new += [(500 + i, "same words here", "N", dt.date(2021, 2, 1)) for i in range(12)]
    want = {}
    for a in new:
        for side, others in (("new", new), ("existing", old)):
            for b in others:
                if side == "new" and a[0] == b[0]:
                    continue
                if a[2] and b[2] and a[2] != b[2]:
                    continue
                if a[3] and b[3] and abs((a[3] - b[3]).days) > 30:
                    continue
                s = jaccard(a[1], b[1])
                if s >= 0.30:
                    n, best = want.get(a[0], (0, 0.0))
                    want[a[0]] = (n + 1, max(best, s))
    schema = "id int, text string, county string, day date"
    args = lambda rows: (spark.createDataFrame(rows, schema), "id", F.col("text"), F.col("county"), F.col("day"))
    matches = U.intake_matches(U.intake_variants(*args(new)), U.intake_variants(*args(old)))
    flagged = U.flag_duplicates(U.intake_members(*args(new)), matches)
    got = {r["record"]: (r["n_matches"], r["best_similarity"]) for r in flagged.collect() if r["is_flagged"]}
    assert got.keys() == want.keys()
    for k, (n, best) in want.items():
        assert got[k][0] == n and abs(got[k][1] - best) < 1e-12
    assert flagged.count() == sum(bool(r[1].split()) for r in new)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_blocks_find_every_overlap(spark, kind, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 40)  # many blocks
    rng = random.Random(3)
    common, rows = [f"of{i}" for i in range(6)], []
    for i in range(230):
        words = common[: rng.randint(1, 6)] + [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 12))]
        day = dt.date(2021, 1, 1) + dt.timedelta(days=rng.randint(0, 200)) if rng.random() < 0.8 else None
        rows.append((i, " ".join(words), rng.choice(["N", "K", "T", None]), day))
    one = U.intake_variants(spark.createDataFrame(rows, "id int, text string, county string, day date").withColumn("id", F.col("id").cast(kind)), "id", F.col("text"), F.col("county"), F.col("day")).cache()
    facts = one.collect()

    def want(left, right, same):
        out = {}
        for a in left:
            for b in right:
                apart = a["county"] and b["county"] and a["county"] != b["county"]
                late = a["day"] and b["day"] and abs((a["day"] - b["day"]).days) > 30
                s = jaccard(" ".join(a["words"]), " ".join(b["words"]))
                if not apart and not late and s >= 0.3 and (not same or a["record"] < b["record"]):
                    out[a["record"], b["record"]] = (a["copies"], b["copies"], s)
        return out

    found = lambda df: {(r[0], r[1]): tuple(r[2:]) for r in df.collect()}
    assert found(U.similar_pairs(one, one, same_side=True)) == want(facts, facts, True)
    part = one.filter("size < 6")
    assert found(U.similar_pairs(one, part)) == want(facts, part.collect(), False)
    assert U.similar_pairs(one, one.filter("size < 0")).count() == 0


def test_products_lose_no_pair_of_a_block(monkeypatch):
    # small products and few places, so that bounds are loose and pairs cross every border
    for name, value in {"TILE": 7, "PLACES": 24, "OWN": 4}.items():
        monkeypatch.setattr(V, name, value)
    rng = random.Random(5)
    sets = [sorted({f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randint(1, 40))}) for _ in range(90)]
    rows = pa.table({
        "record": list(range(90)), "copies": [1] * 90, "county": ["N"] * 90, "day": pa.array([dt.date(2021, 1, 1)] * 90),
        "words": [" ".join(w) for w in sets], "side": pa.array([0] * 90, pa.int32()),
    })
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ca", pa.int64()), ("cb", pa.int64()), ("s", pa.float64())])
    got = {(r["a"], r["b"]): r["s"] for r in V._meet(rows, 0.3, 30, True, kind).to_pylist()}
    every = {(i, j): jaccard(" ".join(sets[i]), " ".join(sets[j])) for i in range(90) for j in range(i + 1, 90)}
    assert got == {p: s for p, s in every.items() if s >= 0.3} and 0 < len(got) < len(every)


def test_texts_are_read_once_and_blocks_meet_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 10)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text

    rows = [(i, f"of w{i % 7} w{i % 5} W{i % 3}\u00a0x\x0b end", "N" if i % 4 else None, dt.date(2021, 1, 1 + i % 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, county string, day date").withColumn("text", told("text"))
    args = (df, "id", F.col("text"), F.col("county"), F.col("day"))
    variants, members = U.intake(*args)
    flagged = U.flag_duplicates(members, U.intake_matches(variants, None)).collect()
    # the test for any word and the words themselves may each call the function
    assert len(flagged) == 60 and read.value <= 120
    plain = [r[:4] for r in U.flag_duplicates(U.intake_members(*args), U.intake_matches(U.intake_variants(*args), None)).collect()]
    assert sorted(r[:4] for r in flagged) == sorted(plain)
    words = {tuple(r["words"]) for r in variants.collect()}
    assert words == {tuple(r["w"]) for r in df.select(F.sort_array(S.word_set(F.col("text"))).alias("w")).collect()}
    held = V.packed(variants)
    plan = V.blocks_overlapping(held, held, T.IntegerType(), T.IntegerType(), 0.3, 30, True)._jdf.queryExecution().executedPlan().toString()
    assert held.count() > 3 and "CartesianProduct" in plan and "Exchange" not in plan


def test_reason_text(spark):
    r = spark.range(1).select(U.match_reason(F.lit(0.456), F.lit("new"), F.lit(7)).alias("r")).first()["r"]
    assert r == "46% similar to new record (7)"


def test_hot_keys_lose_nothing(spark):
    left = spark.sql("select id as l, cast(if(id < 30, 0, id) as int) k from range(60)")
    right = spark.sql("select id as r, cast(if(id < 200, 0, id) as int) k from range(260)")
    assert hotkeys.spread_join(left, right, ["k"], "r", 7).count() == left.join(right, "k").count()


# --- records -------------------------------------------------------------------------------

def test_duplicate_report(spark):
    rows = [("X", 1), ("X", 1), ("X", 2), ("Y", 1), (None, 3), (None, 3), ("Z", 5), ("Z", 5)]
    got = R.duplicate_report(spark.createDataFrame(rows, "id string, v int"), "id").first()
    assert tuple(got) == (6, 7, 1)
    assert R.repeated(spark.createDataFrame(rows, "id string, v int"), ["id"]).count() == 7


def test_collisions_stay_unique(spark):
    rows = [("X", i) for i in range(30)] + [("X-B", 100), ("Y", 101), ("Y", 102)]
    out = R.resolve_collisions(spark.createDataFrame(rows, "id string, n int"), "id", "n").orderBy("n").collect()
    ids = [r["id"] for r in out]
    assert len(set(ids)) == len(rows) and ids[0] == "X" and ids[1] == "X-B-r1" and ids[2] == "X-C" and ids[25] == "X-Z"
    assert ids[26] == "X-27" and ids[30] == "X-B" and ids[31:] == ["Y", "Y-B"]
    assert all(r["Original_id"] in ("X", "X-B", "Y") for r in out)


def test_enrichment_keeps_rows_and_names(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    other = spark.createDataFrame([(1, "other", 5)], "id int, v string, w int")
    out = R.enrich(base, "id", other)
    assert out.columns == ["id", "v", "w"] and sorted(map(tuple, out.collect())) == [(1, "a", 5), (2, "b", None)]


def test_keep_first_and_key_join(spark):
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, None), ("m", 3, "x")], "k string, o int, v string")
    assert sorted(map(tuple, R.keep_first(df, ["k"], "o").collect())) == [("k", 1, None), ("m", 3, "x")]
    left = spark.createDataFrame([(" Athi River ", "MACHAKOS"), ("none", "x")], "a string, c string")
    right = spark.createDataFrame([("athi river", "Machakos ", 1)], "sa string, sc string, g int")
    got = R.key_join(left, right, ("a", "c"), ("sa", "sc")).orderBy("g").collect()
    assert [(r["g"], r["key_matched"]) for r in got] == [(None, False), (1, True)]


@pytest.mark.parametrize("letters, share, alone", [(250, 0.5, None), (250, 0.5, True), (6, 0.5, False), (3, 1.0, None)])
def test_side_by_side_scores_equal_single_ones(letters, share, alone, monkeypatch):
    """Pairs ruled out together and scored together are those of the single comparison, whatever their length."""
    monkeypatch.setattr(A, "LETTERS", letters)
    monkeypatch.setattr(A, "SHARES", (share, 1.0))
    monkeypatch.setattr(A, "LANES", 97)
    if alone is not None:
        monkeypatch.setattr(A, "_cheaper_alone", lambda pairs, words: alone)
    rng = random.Random(letters)
    texts = []
    for _ in range(60):
        words = rng.choices(WORDS + ["été", "süd", "木", "Zug"], k=rng.choice([1, 3, 30, 31, 90, 400]))
        if texts and rng.random() < 0.6:
            words = [w if rng.random() < 0.8 else rng.choice(WORDS) for w in rng.choice(texts).split()]
        texts.append(" ".join(sorted(words)))
    for threshold in (0.0, 62.5, 80.0, 100.0):
        pool = A._Pool(texts)
        i, j = (x.astype(int) for x in A.np.triu_indices(len(texts), 1))
        got = {(a, b): s for i_, j_, s_ in A._alike(pool, iter([(i, j)]), threshold) for a, b, s in zip(i_, j_, s_)}
        scores = {(a, b): S.ratio(texts[a], texts[b]) for a in range(len(texts)) for b in range(a + 1, len(texts))}
        assert got == {pair: s for pair, s in scores.items() if s >= threshold}


def test_few_pairs_of_one_language_are_compared_in_full(monkeypatch):
    """Letter counts let nearly all pairs of long texts pass; the rarer letters must rule out nearly all of them."""
    rng = random.Random(3)
    parts = ["ver", "ein", "sch", "ten", "lich", "ung", "ba", "ko", "mu", "gra", "fol", "pi", "dor"]
    known = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(800)]
    texts = [" ".join(sorted(rng.choices(known, k=rng.randint(180, 220)))) for _ in range(120)]
    texts.append(texts[7] + " zu")
    seen, common = [], A._common
    monkeypatch.setattr(A, "_common", lambda kept, i, j, need: seen.append(len(i)) or common(kept, i, j, need))
    pool = A._Pool(texts)
    i, j = (x.astype(int) for x in A.np.triu_indices(len(texts), 1))
    found = [(a, b) for i_, j_, _ in A._alike(pool, iter([(i, j)]), 80.0) for a, b in zip(i_, j_)]
    assert (7, 120) in found and set(found) == {(a, b) for a, b in zip(i, j) if S.ratio(texts[a], texts[b]) >= 80}
    assert seen[0] > 0.5 * len(i) and seen[-1] < 0.05 * len(i)


def test_blocks_of_texts_meet_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(A, "ROWS", 3)
    rows = records(150, 5)
    df = spark.createDataFrame(rows, "id int, county string, text string, s date, e date")
    variants = U.fold_copies(df, "id", "text", "county", "s", "e")
    held = A._blocks(variants)
    facts = variants.collect()
    blocks = [A.records_of(pa.py_buffer(bytes(r["held"]))) for r in held.filter("held IS NOT NULL").collect()]
    assert len(blocks) > 10 and sorted(i for b in blocks for i in b["record"].to_pylist()) == sorted(r["record"] for r in facts)
    scored = A.alike(variants, 80.0, 30)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    got = {tuple(sorted((r["a_record"], r["b_record"]))) for r in scored.collect()}
    ids = {r["record"] for r in facts}
    # blocks of eight records and one block give the same
    monkeypatch.setattr(A, "ROWS", 4096)
    assert got == {tuple(sorted((r["a_record"], r["b_record"]))) for r in A.alike(variants, 80.0, 30).collect()}
    assert got == {p for p in brute(rows) if p[0] in ids and p[1] in ids} and scored.count() == len(got) > 1


def test_stored_tables_leave_no_shuffle_and_the_settings_as_they_were(spark, tmp_path):
    from panelyard.session import _LEAN, forgotten, released, stored

    before = {k: spark.conf.get(k, None) for k in _LEAN}
    with pytest.raises(ValueError), released(spark):
        assert {k: spark.conf.get(k) for k in _LEAN} == _LEAN
        raise ValueError
    held = stored(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "counts", "zstd")
    assert {k: spark.conf.get(k, None) for k in _LEAN} == before
    assert held.count() == 7
    forgotten(held)
    with pytest.raises(Exception, match="(?i)exist|found"):
        spark.read.parquet(held.inputFiles()[0]).count()
