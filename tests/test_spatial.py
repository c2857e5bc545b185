import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.functions import geo as E
from panelyard.operators import hotkeys
from panelyard.operators import hotspots as H
from panelyard.operators import spatial as S
from panelyard.operators.graph import connected_components


def rings(spark, shapes):
    rows = [(name, "C", name, i, [{"x": float(x), "y": float(y)} for x, y in ring]) for name, i, ring in shapes]
    return spark.createDataFrame(rows, "area_id string, County string, SubCounty string, ring int, points array<struct<x:double,y:double>>")


def test_points_in_polygons(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    hole = [(1, 1), (1, 2), (2, 2), (2, 1)]
    shapes = rings(spark, [("sq", 0, square), ("sq", 1, hole), ("tri", 0, [(3, 3), (8, 3), (3, 8)])])
    points = [("in", "0.5", "0.5"), ("hole", "1.5", "1.5"), ("edge", "4", "2"), ("corner", "0", "0"), ("both", "3.5", "3.5"),
              ("out", "9", "9"), ("null", None, "1"), ("text", "east", "1"), ("far", "1", "95"), ("crowd", "0.5", "0.5"), ("ray", "-1", "4")]
    df = spark.createDataFrame(points, "id string, lon string, lat string")
    for cell in (0.37, 2.0, 50.0):
        got = S.locate_points(df, shapes, "lon", "lat", cell=cell)
        found = {}
        for r in got.collect():
            found.setdefault(r["id"], set()).add(r["joined_subcounty"])
        assert found == {"in": {"sq"}, "hole": {None}, "edge": {None}, "corner": {None}, "both": {"sq", "tri"}, "out": {None},
                         "null": {None}, "text": {None}, "far": {None}, "crowd": {"sq"}, "ray": {None}}
    report = {r["coord_status"]: r["n"] for r in E.coordinate_report(df, "lon", "lat").collect()}
    assert report == {"ok": 8, "missing": 1, "non_numeric": 1, "out_of_range": 1}


def test_utm_known_values(spark):
    df = spark.createDataFrame([(39.0, 0.0), (36.8219, -1.2921), (42.0, -4.0)], "lon double, lat double")
    got = [(r["easting"], r["northing"]) for r in E.with_utm(df, "lon", "lat").collect()]
    assert np.allclose(got[0], (500000.0, 10000000.0), atol=1e-6)
    assert abs(got[1][0] - 257601) < 60 and abs(got[1][1] - 9857083) < 120
    # at the zone edge the grid scale is within a per mille of one
    step = E.with_utm(spark.createDataFrame([(42.0, -4.0), (42.0, -4.01)], "lon double, lat double"), "lon", "lat").collect()
    dist = math.dist(step[0][2:], step[1][2:])
    assert abs(dist - 1105.7) < 2


def cloud(n, seed, clump=0.4):
    rng = random.Random(seed)
    pts = []
    for i in range(n):
        if rng.random() < clump:
            pts.append((i, round(rng.gauss(5, 0.05), 3), round(rng.gauss(5, 0.05), 3)))
        else:
            pts.append((i, round(rng.uniform(0, 30), 3), round(rng.uniform(0, 30), 3)))
    return pts


@pytest.mark.parametrize("seed,rows_per_cell", [(1, 2000), (2, 15)])
def test_nearest_equals_brute_force(spark, seed, rows_per_cell):
    pts = cloud(150, seed)
    df = spark.createDataFrame(pts, "id int, x double, y double")
    got = {}
    for r in S.nearest(df, "id", "x", "y", 4, rows_per_cell).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbor"]
    for i, x, y in pts:
        want = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, a, b in pts if j != i)[:4]
        assert [got[i][k] for k in range(1, 5)] == [j for _, j in want]
    with pytest.raises(ValueError):
        S.nearest(df.limit(4), "id", "x", "y", 4)


def brute_dbscan(pts, eps, min_points):
    near = {i: [j for j, a, b in pts if (x - a) ** 2 + (y - b) ** 2 <= eps * eps] for i, x, y in pts}
    core = {i for i in near if len(near[i]) >= min_points}
    label, number = {}, 0
    for i, _, _ in sorted(pts):
        if i in label or i not in core:
            continue
        stack = [i]
        label[i] = number
        while stack:
            for j in near[stack.pop()]:
                if j in label:
                    continue
                label[j] = number
                if j in core:
                    stack.append(j)
        number += 1
    return {i: label.get(i, -1) for i in near}


@pytest.mark.parametrize("seed,eps,min_points", [(3, 1.0, 3), (4, 2.5, 4), (5, 0.3, 2), (6, 40.0, 3), (7, 0.02, 5)])
def test_dbscan_equals_brute_force(spark, seed, eps, min_points, monkeypatch):
    monkeypatch.setattr(hotkeys.spread_join, "__defaults__", (10,))
    pts = cloud(160, seed) + [(1000 + i, 12.0, 12.0) for i in range(6)] + [(2000 + i, 20 + i * 0.9, 3.0) for i in range(12)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    got = {r["id"]: r["cluster"] for r in S.planar_dbscan(df, eps, min_points).collect()}
    want = brute_dbscan(pts, eps, min_points)
    assert {i: got.get(i, -1) for i in want} == want


def test_geographic_dbscan_marks_unusable_points(spark):
    rows = [(1, "37.0", "-1.0"), (2, "37.01", "-1.0"), (3, "37.0", "-1.01"), (4, "40", "3"), (5, None, "1"), (6, "x", "1"), (7, "200", "1"), (8, "129", "0")]
    got = {r["id"]: r["cluster"] for r in S.dbscan(spark.createDataFrame(rows, "id int, lon string, lat string"), "id", "lon", "lat", 5.0, 3).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: -1, 5: -2, 6: -2, 7: -2, 8: -2}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200)]
    edges = spark.createDataFrame(chain, "a int, b int")
    vertices = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 130), 200, 201, 300]], "v int")
    got = {r["v"]: r["component"] for r in connected_components(vertices, edges, "v").collect()}
    want = {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200, 300: 300}
    assert got == want


def test_density_surface(spark):
    pts = [p for p in cloud(60, 9)] + [(99, 5.0, 5.0)] * 3
    df = spark.createDataFrame([(i, str(x), str(y)) for i, x, y in pts] + [(1, "bad", "1")], "id int, lon string, lat string").repartition(5)
    xy = np.array([(x, y) for _, x, y in pts]).T
    cov = np.cov(xy) * (xy.shape[1] ** (-1 / 6)) ** 2
    inv, norm = np.linalg.inv(cov), 2 * np.pi * np.sqrt(np.linalg.det(cov)) * xy.shape[1]
    out = S.kde_surface(df, "lon", "lat", grid_size=12).collect()
    assert len(out) == 144
    for r in out:
        diff = xy - np.array([[r["lon"]], [r["lat"]]])
        want = np.exp(-0.5 * np.einsum("ij,ik,kj->j", diff, inv, diff)).sum() / norm
        assert math.isclose(r["density"], want, rel_tol=1e-9, abs_tol=1e-300)


def test_permutations_shuffle_counts_only(spark):
    scored = spark.range(30).selectExpr("id", "cast(id * 7 % 11 as double) as value", "cast(id % 5 as double) as lag")
    df = H.permutation_p(scored, "id", 4, 50)
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "hashpartitioning(id" in plan and "turn" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 4
    # by the definition: the same draws, looked up one by one
    values, n = [(7 * i) % 11 for i in range(30)], 30
    turns = spark.range(30).selectExpr("id as _pos", "explode(sequence(1, 50)) as turn")
    draws = turns.select("_pos", H._draw(4, 42, F.lit(n - 1).cast("long"), F.col("_pos"), F.col("turn")).alias("d")).collect()
    larger = [0] * 30
    for r in draws:
        assert len(set(r["d"])) == 4
        larger[r["_pos"]] += sum(values[p + (p >= r["_pos"])] for p in r["d"]) / 4 >= r["_pos"] % 5
    assert {r["id"]: r["gi_pvalue"] for r in df.collect()} == {i: (min(x, 50 - x) + 1) / 51 for i, x in enumerate(larger)}


def test_hotspots(spark):
    pts = cloud(40, 11, clump=0.0)
    rows = [(i, x, y, x) for i, x, y in pts] + [(99, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id int, x double, y double, v double")
    first = {r["id"]: r for r in H.hotspots(df, "id", "x", "y", "v", permutations=199).collect()}
    again = {r["id"]: r for r in H.hotspots(df.repartition(7), "id", "x", "y", "v", permutations=199).collect()}
    assert len(first) == 40 and {i: r["gi_pvalue"] for i, r in first.items()} == {i: r["gi_pvalue"] for i, r in again.items()}
    assert all(0 < r["gi_pvalue"] <= 0.51 for r in first.values())
    values = np.array([p[1] for p in pts])
    for i, x, y in pts:
        near = [j for _, j in sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in pts if j != i)[:4]]
        others = np.array([a for j, a, _ in pts if j != i])
        lag = np.mean([values[j] for j in near])
        z = (lag - others.mean()) / (others.std() * math.sqrt((39 / 4 - 1) / 38))
        assert math.isclose(first[i]["gi_zscore"], z, rel_tol=1e-9)
        # a far-out z needs a small p-value
        if abs(z) > 3:
            assert first[i]["gi_pvalue"] <= 0.05


def test_draws_are_distinct(spark):
    drawn = spark.range(200).select(H._draw(4, 1, F.lit(5), F.col("id"), F.col("id") % 3).alias("d")).collect()
    assert all(len(set(r["d"])) == 4 and set(r["d"]) <= set(range(5)) for r in drawn)
    counts = np.bincount([v for r in drawn for v in r["d"]], minlength=5)
    assert counts.min() > 130


@pytest.mark.parametrize("crowd", [3, 60])
def test_nearest_folds_equal_points(spark, crowd, monkeypatch):
    """Crowds at a few spots, ties between spots, keys out of order and points without coordinates."""
    rng = random.Random(crowd)
    pts = [(i, *rng.choice([(0.0, 0.0), (-0.0, 1.0), (1.0, 0.0), (5.0, 5.0)])) for i in range(crowd)] + [(200 + i, float(rng.randint(-2, 2)), float(rng.randint(-2, 2))) for i in range(12)]
    rng.shuffle(pts)
    df = spark.createDataFrame([*pts, (900, None, 1.0), (901, 1.0, None)], "id int, x double, y double")
    small = lambda left, right, keys, row_id: hotkeys.spread_join(left, right, keys, row_id, rows_per_task=2)
    monkeypatch.setattr(S, "spread_join", small)
    got = {}
    for r in S.nearest(df, "id", "x", "y", 3, rows_per_cell=5).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"], round(r["distance"], 9)))
    want = {}
    for i, x, y in pts:
        near = sorted((math.dist((x, y), (a, b)), j) for j, a, b in pts if j != i)[:3]
        want[i] = [(k + 1, j, round(d, 9)) for k, (d, j) in enumerate(near)]
    assert {i: sorted(v) for i, v in got.items()} == want


def test_nearest_at_one_spot(spark):
    df = spark.range(6).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    got = sorted((r["id"], r["rank"], r["neighbor"], r["distance"]) for r in S.nearest(df, "id", "x", "y", 2).collect())
    assert got == [(i, k + 1, j, 0.0) for i in range(6) for k, j in enumerate([j for j in range(6) if j != i][:2])]
    with pytest.raises(ValueError):
        S.nearest(df.limit(2), "id", "x", "y", 2)


def test_crowded_cells_are_spread(spark, monkeypatch):
    """Points of one cell in many tasks find the polygons they find in one."""
    shapes = rings(spark, [("a", 0, [(0, 0), (4, 0), (4, 4), (0, 4)]), ("b", 0, [(3, 3), (8, 3), (3, 8)])])
    df = spark.range(300).select(F.col("id"), (F.col("id") % 20 * 0.37 + 0.05).alias("lon"), (F.floor(F.col("id") / 20) * 0.41 + 0.05).alias("lat"))
    plain = {tuple(r) for r in S.locate_points(df, shapes, "lon", "lat", cell=5.0).collect()}
    seen = []

    def small(left, right, keys, row_id):
        out = hotkeys.spread_join(left, right, keys, row_id, rows_per_task=10)
        seen.append(out)
        return out

    monkeypatch.setattr(S, "spread_join", small)
    spread = [tuple(r) for r in S.locate_points(df, shapes, "lon", "lat", cell=5.0).collect()]
    assert seen and len(spread) == len(set(spread)) and set(spread) == plain
