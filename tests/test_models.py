import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators import explain as E
from panelyard.operators import forecast as G
from panelyard.operators import topics as T


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(2)
    rows = []
    for area in range(6):
        level = 0.0
        for i in range(72):
            level = 0.8 * level + rng.normal()
            rows.append((f"a{area}", 2000 + i // 12, i % 12 + 1, float(level), float(area), int(level + rng.normal() > 1.0)))
    df = spark.createDataFrame(rows, "SubCounty string, Year int, Month int, x double, s double, conflict_onset int")
    return df.withColumn("panel_date", F.make_date("Year", "Month", F.lit(1)))


def test_lags_never_look_ahead(panel):
    lagged = G.add_lags(panel, "SubCounty", ["x"], 3).orderBy("SubCounty", "panel_date").collect()
    for a in range(6):
        part = lagged[a * 72 : a * 72 + 72]
        assert [r["x_lag3"] for r in part] == [None] * 3 + [r["x"] for r in part[:-3]]


def test_modelling_table_and_split(panel):
    rows, features = G.modelling_table(panel, 3, dynamic=["x", "absent"], static=["s"])
    assert features == ["x_lag3", "s"] and rows.count() == 6 * 69
    train, test = G.temporal_split(rows, 2004)
    assert train.agg(F.max("Year")).first()[0] == 2003 and test.agg(F.min("Year")).first()[0] == 2004
    assert train.count() + test.count() == rows.count()


def test_folds_are_in_time_order(panel):
    folds = G.time_folds(panel, 5).groupBy("fold").agg(F.min("panel_date").alias("a"), F.max("panel_date").alias("b")).orderBy("fold").collect()
    assert [r["fold"] for r in folds] == list(range(6))
    assert all(x["b"] < y["a"] for x, y in zip(folds, folds[1:]))


def test_settings():
    assert len(G.grid(G.fv.FOREST_GRID)) == 24 and len(G.grid(G.fv.LOGISTIC_GRID)) == 8
    some = G.draws(G.fv.BOOSTING_CHOICES)
    assert len(some) == 40 and some == G.draws(G.fv.BOOSTING_CHOICES) and len({tuple(s.items()) for s in some}) == 40
    assert len(G.draws({"depth": [1, 2]}, 40)) == 2


def test_horizons(panel):
    out = G.run_horizons(panel, "SubCounty", ["x"], horizons=(1,), models={"Logistic Regression": [{"C": 1.0}], "Random Forest": [{"trees": 5, "depth": 3}]}, cutoff=2004, splits=2)
    metrics = out["metrics"].collect()
    assert {(r["model"], r["threshold_kind"]) for r in metrics} == {(m, k) for m in ("Logistic Regression", "Random Forest") for k in ("default", "tuned")}
    assert all(r["roc_auc"] > 0.6 for r in metrics) and all(r["total"] == 6 * 24 for r in out["confusion"].collect())
    assert out["calibration"].count() > 4
    one_class = G.run_horizons(panel.withColumn("conflict_onset", F.lit(0)), "SubCounty", ["x"], horizons=(1,), models={"Logistic Regression": [{}]}, cutoff=2004)
    assert one_class == {}


def test_one_class_gives_empty_tables(spark, panel, tmp_path):
    # a large panel may have the event in every area and month
    setting = {"models": {"Logistic Regression": [{"C": 1.0}]}, "horizons": (1, 3), "cutoff": 2004, "splits": 2, "always": True}
    some = G.run_horizons(panel, "SubCounty", ["x"], **setting)
    none = G.run_horizons(panel.withColumn("conflict_onset", F.lit(1)), "SubCounty", ["x"], **setting)
    assert none.keys() == some.keys()
    for name, df in none.items():
        assert df.collect() == [] and [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in some[name].schema], name


@pytest.mark.parametrize("name", ["lr_scores", "rf_scores", "gbt_scores", "horizon_metrics"])
def test_forecast_queries_take_one_class(spark, tmp_path, name):
    from panelyard.plans.all_queries import QUERIES

    nations = spark.range(25).selectExpr("cast(id as int) as n_nationkey", "cast(id % 5 as int) as n_regionkey")
    nations.write.parquet(str(tmp_path / "nation.parquet"))
    spark.range(25).selectExpr("id as c_custkey", "cast(id as int) as c_nationkey", "1.0D as c_acctbal", "'BUILDING' as c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    month = "add_months(date'1995-01-01', cast(id div 25 as int))"
    spark.range(25 * 80).selectExpr(
        "id as o_orderkey", "id % 25 as o_custkey", f"cast({month} as timestamp) as o_orderdate", "'1-URGENT' as o_orderpriority", "500000.0D as o_totalprice", "'F' as o_orderstatus"
    ).write.parquet(str(tmp_path / "orders.parquet"))
    out = QUERIES[name](spark, str(tmp_path))
    assert out.count() == 0 and "model" in out.columns


def brute_shap(x, leaves, n_features):
    def value(known):
        total = 0.0
        for v, way in leaves:
            for f, low, high, share in way:
                v *= (low < x[f] <= high) if f in known else share
            total += v
        return total

    phi = []
    for i in range(n_features):
        others = [j for j in range(n_features) if j != i]
        total = 0.0
        for k in range(n_features):
            for s in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(n_features - 1 - k) / math.factorial(n_features)
                total += w * (value({*s, i}) - value(set(s)))
        phi.append(total)
    return phi


@pytest.mark.parametrize("build,setting", [(G.boosting, {"rounds": 4, "depth": 3}), (G.forest, {"trees": 4, "depth": 4})])
def test_tree_attribution_is_exact(spark, panel, build, setting):
    rows, features = G.modelling_table(panel.withColumn("y", F.col("x") * F.col("x")), 1, dynamic=["x", "y"], static=["s"])
    model = G.fit(build, rows, features, setting)
    last = model.stages[-1]
    leaves = E.tree_leaves(last)
    few = rows.limit(8)
    got = {}
    for r in E.tree_attribution(few, ["SubCounty", "panel_date"], features, last).collect():
        got.setdefault((r["SubCounty"], r["panel_date"]), {})[r["feature"]] = r["attribution"]
    base = E.expected_margin(leaves)
    for r in G.score_rows(model, few).collect():
        phi = [got[r["SubCounty"], r["panel_date"]][f] for f in features]
        assert np.allclose(phi, brute_shap([r[f] for f in features], leaves, 3), atol=1e-10)
        margin = base + sum(phi)
        want = 1 / (1 + math.exp(-2 * margin)) if build is G.boosting else margin
        assert math.isclose(r["score"], want, rel_tol=1e-9)


def test_linear_attribution_and_text(spark):
    df = spark.createDataFrame([(1, 1.0, 4.0), (2, 3.0, 0.0)], "id int, a double, b double")
    attr = E.linear_attribution(df, ["id"], {"a": 2.0, "b": -1.0})
    assert {(r["id"], r["feature"]): r["attribution"] for r in attr.collect()} == {(1, "a"): -2.0, (1, "b"): -2.0, (2, "a"): 2.0, (2, "b"): 2.0}
    text = E.policy_statements(E.attribution_summary(attr.filter("id = 1")), 1).first()
    assert text["statement"] == "1. a: mean |SHAP| = 2.0000 -- HIGHER values of this feature DECREASE predicted risk"


def test_logistic_coefficients(panel):
    rows, features = G.modelling_table(panel, 1, dynamic=["x"], static=["s"])
    model = G.fit(G.logistic, rows, features, {"C": 1.0})
    b = E.logistic_coefficients(model, features)
    a, c = G.score_rows(model, rows.limit(2)).collect()
    logit = lambda p: math.log(p / (1 - p))
    assert math.isclose(logit(a["score"]) - logit(c["score"]), sum(b[f] * (a[f] - c[f]) for f in features), rel_tol=1e-6, abs_tol=1e-9)


# --- topics ----------------------------------------------------------------------------------

def vectors(spark, n=120, twist=False):
    rng = np.random.default_rng(4)
    words = [["river", "dam"], ["land", "title"], ["cattle", "raid"]]
    rows = []
    for i in range(n):
        c = i % 3
        v = np.eye(3)[c] + rng.normal(0, 0.05, 3)
        late = i >= 90
        if late and twist:
            v, tokens = rng.normal(0, 1, 3), ["new", "words"]
        else:
            tokens = [words[c][j % 2] for j in range(4)] + [f"w{i % 5}"]
        rows.append((i, [float(x) for x in v], tokens, "2021-01-01" if late else "2020-01-01"))
    rows.append((n, [1.0, 0.0, 0.0], ["river"], None))
    return spark.createDataFrame(rows, "id int, v array<double>, tokens array<string>, d string")


def test_topics_find_the_groups(spark):
    df = vectors(spark)
    model = T.fit_topics(df, "v", n_clusters=3, min_topic_size=5)
    out = model.assign(df, "v")
    assert {r["topic_id"] for r in out.collect()} <= {-1, 0, 1, 2}
    kept = out.filter("topic_id >= 0")
    assert kept.groupBy("topic_id").agg(F.countDistinct(F.col("id") % 3).alias("n")).filter("n > 1").count() == 0
    assert kept.filter("topic_probability < 0.5").count() == 0
    assert out.filter("topic_id = -1 AND topic_probability IS NOT NULL").count() == 0
    small = T.fit_topics(df, "v", n_clusters=3, min_topic_size=1000)
    assert {r["topic_id"] for r in small.assign(df, "v").collect()} == {-1}


def test_later_text_never_shapes_topics(spark):
    def run(twist):
        out = T.fit_topics_before(vectors(spark, twist=twist), "id", "v", "tokens", "d", "2020-06-01", n_clusters=3, min_topic_size=5, target=2)
        return {r["id"]: (r["is_train"], r["topic_id"], r["topic_name"]) for r in out.collect()}

    a, b = run(False), run(True)
    assert a.keys() == b.keys() and {i: a[i] for i in range(90)} == {i: b[i] for i in range(90)}
    assert not a[120][0] and len({t for _, t, _ in a.values() if t >= 0}) <= 2


def test_terms_and_merges(spark):
    df = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["a"]), (2, [])], "id int, t array<string>")
    got = [r["t"] for r in df.select(T.terms(F.col("t")).alias("t"), "id").orderBy("id").collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]
    sims = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.8), (0, 2, 0.1), (2, 3, 0.5)], "t1 int, t2 int, similarity double")
    topics = spark.createDataFrame([(t,) for t in (-1, 0, 1, 2, 3)], "topic int")
    mapping, history = T.merge_topics(sims, topics, "topic", 2)
    assert {r["topic"]: r["coarse_topic"] for r in mapping.collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    assert [(r["kept"], r["merged"]) for r in history.orderBy("step").collect()] == [(0, 1), (2, 3)]
    coarse = T.with_coarse(topics, "topic", mapping)
    assert coarse.filter("topic = -1").first()["coarse_topic"] == -1


def test_vectors(spark):
    df = vectors(spark)
    model = T.fit_text_vectors(df, "tokens", vocabulary=50, dimensions=4)
    assert {len(r["vector"]) for r in T.text_vectors(df, model).collect()} == {4}

    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype="float32")

    got = T.model_vectors(spark.createDataFrame([("abc",), (None,)], "t string"), "t", make).collect()
    assert [list(r["vector"]) for r in got] == [[3.0, 1.0], [0.0, 1.0]]


def test_text_vectors_are_those_of_the_library_and_read_texts_once(spark):
    """The same vectors as Spark's own principal components, up to the sign, from one reading of the texts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, PCA, HashingTF

    rng = np.random.default_rng(5)
    rows = [(k, [f"w{int(w)}" for w in rng.zipf(1.5, 30 * (k % 40)) % 300]) for k in range(400)]
    read = spark.sparkContext.accumulator(0)

    def counted(n):
        read.add(1)
        return n

    df = spark.createDataFrame(rows, "id int, tokens array<string>").repartition(3)
    once = df.withColumn("tokens", F.when(F.udf(counted, "int")("id") >= 0, F.col("tokens")))
    model = T.fit_text_vectors(once, "tokens", vocabulary=64, dimensions=5)
    assert read.value == len(rows)
    got = {r["id"]: r["vector"] for r in T.text_vectors(df, model).collect()}
    stages = [HashingTF(inputCol="tokens", outputCol="f", numFeatures=64), IDF(inputCol="f", outputCol="g"), PCA(k=5, inputCol="g", outputCol="v")]
    want = {r["id"]: r["v"].toArray() for r in Pipeline(stages=stages).fit(df).transform(df).select("id", "v").collect()}
    a, b = (np.array([x[k] for k in range(len(rows))]) for x in (got, want))
    sign = np.sign((a * b).sum(axis=0))
    assert np.allclose(a, b * sign, atol=1e-8)


def test_texts_are_read_once(spark):
    """The tokens behind weights and similarities are computed once, those of outliers once more."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(i):
        read.add(1)
        return [f"w{i % 7}", f"w{i % 5}", "all"]

    def docs():
        return spark.range(40).select(F.col("id").alias("doc"), (F.col("id") % 4 - 1).cast("int").alias("topic"), words("id").alias("t"))

    def reads(run):
        before = read.value
        run(docs())
        return read.value - before

    assert reads(lambda df: T.topic_similarity(T.topic_weights(df, "topic", "t"), "topic").collect()) == 40
    assert reads(lambda df: T.top_terms(T.topic_weights(df, "topic", "t"), "topic").collect()) == 40
    assert reads(lambda df: T.reassign_outliers(df, "doc", "topic", "t").select("doc", "new_topic").collect()) <= 40 + 10


def test_terms_of_one_topic_count_for_length_only(spark):
    weights = spark.createDataFrame([(0, "a", 3.0, 2), (0, "b", 4.0, 1), (1, "a", 1.0, 2), (-1, "c", 9.0, 1)], "topic int, term string, weight double, topics long")
    assert [tuple(r) for r in T.topic_similarity(weights, "topic").collect()] == [(0, 1, 0.6)]


def sequential_merges(sims, ids, target):
    """One pair at a time: the closest groups by average similarity, ties to the smallest ids."""
    groups, history = {i: [i] for i in ids}, []
    while len(groups) > max(1, target):
        def mean(a, b):
            return sum(sims.get((min(x, y), max(x, y)), 0.0) for x in groups[a] for y in groups[b]) / (len(groups[a]) * len(groups[b]))

        _, a, b = min((-round(mean(a, b), 12), a, b) for a in groups for b in groups if a < b)
        history.append((a, b, round(1 - mean(a, b), 9)))
        groups[a] += groups.pop(b)
    return {x: a for a, members in groups.items() for x in members}, history


@pytest.mark.parametrize("n,target,share", [(25, 6, 0.5), (16, 1, 0.1), (9, 3, 0.0)])
def test_rounds_of_mutual_merges_equal_one_by_one(spark, n, target, share):
    rng = random.Random(n)
    sims = {(i, j): round(rng.random(), 6) for i in range(n) for j in range(i + 1, n) if rng.random() < share}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "t1 int, t2 int, similarity double")
    topics = spark.createDataFrame([(i,) for i in [-1, *range(n)]], "topic int")
    mapping, history = T.merge_topics(df, topics, "topic", target)
    want, steps = sequential_merges(sims, range(n), target)
    assert {r["topic"]: r["coarse_topic"] for r in mapping.collect()} == want
    got = [(r["kept"], r["merged"], round(r["distance"], 9)) for r in history.orderBy("step").collect()]
    assert got == steps


def test_no_limit_on_topics_to_merge(spark):
    # 3,000 topics in 1,000 triples, tied alike
    pairs = [(3 * k + i, 3 * k + j, 0.5 + 0.4 * (i == 0 and j == 1)) for k in range(1000) for i, j in ((0, 1), (0, 2), (1, 2))]
    df = spark.createDataFrame(pairs, "t1 int, t2 int, similarity double")
    topics = spark.range(3000).selectExpr("cast(id as int) as topic")
    mapping, history = T.merge_topics(df, topics, "topic", 1000)
    assert {(r["topic"], r["coarse_topic"]) for r in mapping.collect()} == {(t, t // 3 * 3) for t in range(3000)}
    assert history.count() == 2000


@pytest.mark.parametrize("parts, gathered, longest", [(16, 2_000_000, 2), (700, 30, 3), (16, 100, 1)])
def test_reassigned_by_packed_counts_as_by_joined_terms(spark, monkeypatch, parts, gathered, longest):
    monkeypatch.setattr(T, "PARTS", parts)
    monkeypatch.setattr(T, "GATHERED", gathered)
    rng = np.random.default_rng(parts + gathered)
    rows = []
    for i in range(120):
        topic = None if i % 17 == 0 else int(rng.integers(-1, 6))
        words = [f"w{int(k)}" for k in rng.exponential(4 + (topic or 0), rng.integers(0, 30))]
        rows.append((f"k{i % 110}" if i % 23 else None, topic, None if i % 29 == 0 else words))
    rows.append(("alone", -1, ["nowhere"]))
    df = spark.createDataFrame(rows, "key string, topic int, words array<string>").repartition(5)
    weights = T.topic_weights(df, "topic", "words", longest)
    idf = weights.filter("topic = -1").select("term", "idf")
    want = T.reassign_outliers(df, "key", "topic", "words", longest, weights=weights)
    got = T.reassign_outliers(df, "key", "topic", "words", longest)
    told = lambda found: sorted(((r["key"], r["topic"], r["words"], r["new_topic"]) for r in found.collect()), key=repr)
    assert told(got) == told(want) and idf.count() > 10
    lost = got.filter("topic = -1")
    assert lost.filter("new_topic >= 0").count() > 10 and lost.filter("key = 'alone'").first()["new_topic"] == -1
