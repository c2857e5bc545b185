"""Keys of any type, nulls in the order, absurd dates and letters outside the usual ones."""

import datetime as dt
import json
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from panelyard.functions import cleaning as C
from panelyard.functions.names import normalize_name
from panelyard.operators import hotspots as H
from panelyard.operators import ordering as O
from panelyard.operators import panel as P
from panelyard.operators import records as R
from panelyard.operators import spatial as S
from panelyard.operators import topics as T
from panelyard.operators.dedupe import match_reason
from panelyard.operators.graph import connected_components
from panelyard.operators.hotkeys import crowd_join, spread_join
from panelyard.sources.tables import read_boundaries


@pytest.mark.parametrize("kind, make", [
    ("string", lambda i: f"KEN-{i:04d}é"), ("date", lambda i: dt.date(2000, 1, 1) + dt.timedelta(days=i)),
    ("long", lambda i: 2**60 + i), ("decimal(38,0)", lambda i: Decimal(10**30 + i)), ("binary", lambda i: bytes([i // 256, i % 256])),
])
def test_numbers_follow_any_key(spark, kind, make):
    order = list(range(700))
    random.Random(1).shuffle(order)
    rows = [(make(i), i % 3) for i in order] + [(None, 0)]
    df = spark.createDataFrame(rows, f"k {kind}, g int").repartition(7)
    got = O.numbered(df, "k", "no", parts=8).collect()
    want = {make(i): i + 1 for i in range(700)}
    assert {(bytes(r["k"]) if kind == "binary" else r["k"]): r["no"] for r in got if r["k"] is not None} == want
    assert [r["no"] for r in got if r["k"] is None] == [701]


def test_string_keys_in_operators(spark):
    rng = random.Random(3)
    points = [(f"id{k:03d}", 36.8 + rng.gauss(0, 0.02) + k % 2, -1.2 + rng.gauss(0, 0.02)) for k in range(80)]
    df = spark.createDataFrame(points, "id string, lon double, lat double")
    number = {name: k for k, (name, _, _) in enumerate(points)}
    longs = spark.createDataFrame([(number[n], x, y) for n, x, y in points], "id long, lon double, lat double")
    by_text = {number[r["id"]]: r["cluster"] for r in S.dbscan(df, "id", "lon", "lat", 5.0, 4).collect()}
    assert by_text == {r["id"]: r["cluster"] for r in S.dbscan(longs, "id", "lon", "lat", 5.0, 4).collect()}
    valued = df.withColumn("v", F.col("lon") - 36)
    assert H.hotspots(valued, "id", "v", "lon", "lat", permutations=20).count() == 80


def test_collisions_with_a_text_order(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "c")], "id string, at string")
    got = {(r["at"], r["id"]) for r in R.resolve_collisions(df, "id", "at").collect()}
    assert got == {("a", "x"), ("b", "x-B"), ("c", "y")}


def test_first_rows_without_an_order(spark):
    df = spark.createDataFrame([("a", None, 7), ("b", 2, 1), ("b", None, 3), ("b", 1, 2)], "k string, o int, v int")
    assert {r["k"]: r["v"] for r in R.keep_first(df, ["k"], "o").collect()} == {"a": 7, "b": 2}
    grid = spark.createDataFrame([("a",), ("b",)], "k string")
    assert {r["k"]: r["v"] for r in P.add_static_first(grid, df, "k", "o", ["v"]).collect()} == {"a": 7, "b": 2}


def test_absurd_dates_leave_the_panel_right(spark):
    grid = P.build_grid(spark.createDataFrame([("a",)], "area string"), "2020-01-01", "2020-12-01")
    rows = [("a", dt.date(201, 6, 1), False, 1.0), ("a", dt.date(2020, 1, 1), False, 1.0), ("a", dt.date(9000, 1, 1), True, 1.0)]
    events = spark.createDataFrame(rows, "area string, start date, composite boolean, severity double")
    got = P.add_conflict_features(grid, events, "area", "start", "severity", "composite").collect()
    for r in got:
        assert r["conflict_persistence"] == pytest.approx(0.5 ** ((r["panel_date"] - dt.date(2020, 1, 1)).days / 180), rel=1e-9)


def test_long_grids_keep_decaying(spark):
    grid = P.build_grid(spark.createDataFrame([("a",)], "area string"), "1990-01-01", "2020-12-01")
    days = [dt.date(1990, 1, 1), dt.date(1999, 5, 20), dt.date(2004, 7, 3), dt.date(2004, 9, 1), dt.date(2015, 2, 2)]
    events = spark.createDataFrame([("a", d, False, 1.0) for d in days], "area string, start date, composite boolean, severity double")
    got = P.add_conflict_features(grid, events, "area", "start", "severity", "composite", days=3.0).collect()
    for r in got:
        want = sum(0.5 ** ((r["panel_date"] - d).days / 3.0) for d in days if d <= r["panel_date"])
        assert r["conflict_persistence"] == pytest.approx(want, rel=1e-9, abs=1e-140)


def test_letters_beyond_the_usual_ones(spark):
    names = ["Hồ Tây", "İstanbul", "Åre-ﬁord", "Ŝkoļa", "ｗｉｄｅ", None, "Ðe"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(normalize_name(F.col("n"), {}))
    assert [r[0] for r in df.collect()] == ["ho tay", "istanbul", "are fiord", "skola", "wide", "", "e"]


def test_text_encoded_many_times_over(spark):
    text = "Kĩambu – né"
    broken = text
    for _ in range(6):
        broken = broken.encode("utf-8").decode("latin-1")
    df = spark.createDataFrame([(broken,)], "t string").select(C.undo_double_encoding(F.col("t")))
    assert df.first()[0] == text


def test_percent_is_half_even(spark):
    df = spark.createDataFrame([(0.305,), (0.125,), (0.5,)], "s double")
    got = [r[0] for r in df.select(match_reason(F.col("s"), F.lit("new"), F.lit(1))).collect()]
    assert [x.split(" ")[0] for x in got] == ["30%", "12%", "50%"]


def test_crowds_meet_their_key(spark):
    rows = spark.range(9000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500))
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = crowd_join(rows, per_key, "k", "n", 9000)
    plain = rows.join(per_key, "k").select(*got.columns)
    assert got.count() == 9000 and got.exceptAll(plain).count() == 0


def test_components_of_a_star_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 4000)] + [(5000 + i, 5001 + i) for i in range(90)]
    vertices = spark.range(6000).withColumnRenamed("id", "v")
    got = connected_components(vertices, spark.createDataFrame(edges, "a long, b long"), "v").collect()
    for r in got:
        assert r["component"] == (0 if r["v"] < 4000 else 5000 if 5000 <= r["v"] <= 5090 else r["v"])


def test_boundaries_keep_areas_without_a_polygon(spark, tmp_path):
    square = lambda x: [[[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 0.0]]]
    shapes = {
        "none": None, "one": {"type": "Polygon", "coordinates": square(0.0)}, "many": {"type": "MultiPolygon", "coordinates": [square(2.0), square(4.0)]},
        "mixed": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": square(6.0)}, {"type": "MultiPolygon", "coordinates": [square(8.0)]}]},
    }
    features = [{"type": "Feature", "properties": {"c": "K", "s": name}, "geometry": g} for name, g in shapes.items()]
    path = tmp_path / "areas.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = read_boundaries(spark, str(path), "c", "s", crs="EPSG:4326").collect()
    found = sorted((r["SubCounty"], r["ring"], r["points"][0]["x"] if r["points"] else None) for r in rows if r["SubCounty"] != "none")
    assert found == [("many", 0, 2.0), ("many", 1, 4.0), ("mixed", 0, 6.0), ("mixed", 1, 8.0), ("one", 0, 0.0)]
    assert [(r["ring"], r["points"]) for r in rows if r["SubCounty"] == "none"] == [(None, None)]
    features[0]["geometry"] = {"type": "Point", "coordinates": [1.0, 2.0]}
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    with pytest.raises(Exception, match="no polygon"):
        read_boundaries(spark, str(path), "c", "s", crs="EPSG:4326").collect()


def test_spread_join_with_hot_keys_on_both_sides(spark):
    left = spark.range(600).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(400).select(F.col("id").alias("b"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    got = spread_join(left, right, ["k"], "b", rows_per_task=40)
    plain = left.join(right, ["k"])
    assert got.count() == plain.count() and got.select("a", "b", "k").exceptAll(plain.select("a", "b", "k")).count() == 0


def test_pairs_within_a_distance(spark):
    rng = random.Random(5)
    spots = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(150)] + [(900, 1.0, 1.0), (901, 1.0, 1.0), (902, None, 1.0)]
    df = spark.createDataFrame(spots, "id long, x double, y double")
    got = {(r["a"], r["b"]) for r in S.within_distance(df, "id", "x", "y", 0.7).collect()}
    known = [s for s in spots if s[1] is not None]
    assert got == {(p[0], q[0]) for p in known for q in known if p[0] < q[0] and math.hypot(p[1] - q[1], p[2] - q[2]) <= 0.7}


def test_embedding_backend_by_name(spark):
    df = spark.createDataFrame([(1, "a b", ["a", "b"]), (2, "b c", ["b", "c"]), (3, None, [])], "id int, t string, w array<string>")
    assert all(len(r["vector"]) == 3 for r in T.embed(df, "tfidf", "t", "w", vocabulary=16, dimensions=3).collect())

    def make_predict():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    assert [list(r["vector"]) for r in T.embed(df, "model", "t", "w", make_predict=make_predict).orderBy("id").collect()] == [[3, 1], [3, 1], [0, 1]]
    with pytest.raises(ValueError, match="no embedding backend"):
        T.embed(df, "other", "t", "w")
