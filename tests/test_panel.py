import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelyard.operators import panel as P

EVENTS = [
    ("a", dt.date(2020, 1, 1), False, 2.0, 0.5, 1), ("a", dt.date(2020, 1, 15), True, None, None, 2),
    ("a", dt.date(2020, 3, 31), False, 1.0, -0.5, 2), ("a", dt.date(2019, 5, 5), None, 3.0, 0.1, None),
    ("b", dt.date(2020, 6, 1), False, 1.0, 0.2, 5), ("b", None, False, 1.0, 0.2, 5), (None, dt.date(2020, 2, 2), False, 1.0, 0.2, 5),
    ("a", dt.date(2021, 3, 1), False, 1.0, 0.9, 9),
]
SCHEMA = "area string, start date, composite boolean, severity double, tone double, topic int"


@pytest.fixture(scope="module")
def grid(spark):
    areas = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "area string")
    return P.build_grid(areas, "2019-12-15", "2020-12-01")


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(EVENTS, SCHEMA).repartition(5)


def plain(area, day, days=180.0, severity=False):
    total = 0.0
    for a, s, slow, sev, _, _ in EVENTS:
        if a == area and s is not None and s <= day:
            w = math.exp(-math.log(2) * (day - s).days / (days * 3 if slow else days))
            total += w * ((sev or 0.0) if severity else 1.0)
    return total


def test_grid(grid):
    rows = grid.collect()
    assert len(rows) == 3 * 12 and min(r["panel_date"] for r in rows) == dt.date(2020, 1, 1)
    assert {(r["Year"], r["Month"]) for r in rows} == {(2020, m) for m in range(1, 13)}


def test_features_equal_the_definition(grid, events):
    out = P.add_conflict_features(grid, events, "area", "start", "severity", "composite").collect()
    assert len(out) == 36
    for r in out:
        assert math.isclose(r["conflict_persistence"], plain(r["area"], r["panel_date"]), abs_tol=1e-12)
        assert math.isclose(r["conflict_severity_weighted"], plain(r["area"], r["panel_date"], severity=True), abs_tol=1e-12)
        begun = any(e[0] == r["area"] and e[1] and e[1].replace(day=1) == r["panel_date"] for e in EVENTS)
        assert r["conflict_onset"] == begun


def test_presummed_equals_range_join(grid, events):
    fast = {(r["area"], r["panel_date"]): r["conflict_persistence"] for r in P.add_conflict_features(grid, events, "area", "start", "severity", "composite").collect()}
    for r in P.decayed_sum_by_pairs(grid, events, "area", "start", "composite").collect():
        assert math.isclose(fast[r["area"], r["panel_date"]], r["conflict_persistence"], rel_tol=1e-10, abs_tol=1e-12)


def test_later_events_change_nothing_before(spark, grid, events):
    more = events.unionByName(spark.createDataFrame([("a", dt.date(2020, 7, 2), False, 9.0, 1.0, 3)], SCHEMA))
    pick = lambda e: {
        (r["area"], r["panel_date"]): tuple(r)
        for r in P.add_text_features(P.add_conflict_features(grid, e, "area", "start", "severity", "composite").drop("conflict_onset"), e, "area", "start", "composite", "tone", "topic").filter("panel_date <= '2020-07-01'").collect()
    }
    assert pick(events) == pick(more)


def test_text_features(grid, events):
    out = {(r["area"], r["panel_date"]): r for r in P.add_text_features(grid, events, "area", "start", "composite", "tone", "topic").collect()}
    none = out["b", dt.date(2020, 5, 1)]
    assert none["decayed_sentiment"] is None and none["dominant_topic_id"] is None and none["topic_diversity"] is None
    single = out["b", dt.date(2020, 7, 1)]
    assert single["dominant_topic_id"] == 5 and abs(single["topic_diversity"]) < 1e-9 and math.isclose(single["decayed_sentiment"], 0.2)
    day = dt.date(2020, 4, 1)
    num = den = 0.0
    by_topic = {}
    for a, s, slow, _, tone, topic in EVENTS:
        if a == "a" and s <= day:
            w = math.exp(-math.log(2) * (day - s).days / (540 if slow else 180))
            num, den = num + w * (tone or 0.0), den + w
            by_topic[topic or -1] = by_topic.get(topic or -1, 0.0) + w
    r = out["a", day]
    assert math.isclose(r["decayed_sentiment"], num / den, rel_tol=1e-12)
    assert r["dominant_topic_id"] == max(by_topic, key=by_topic.get)
    assert math.isclose(r["topic_diversity"], -sum(w / den * math.log(w / den) for w in by_topic.values()), rel_tol=1e-9)
    assert out["c", day]["topic_diversity"] is None


def test_partitioning_does_not_matter(grid, events):
    runs = [
        sorted((r["area"], r["panel_date"], round(r["conflict_persistence"], 10)) for r in P.add_conflict_features(grid, events.repartition(n), "area", "start", "severity", "composite").collect())
        for n in (1, 4, 32)
    ]
    assert runs[0] == runs[1] == runs[2]


def test_no_event_and_tiny_half_life(spark, grid, events):
    none = events.filter("area = 'zzz'")
    assert {r[0] for r in P.add_conflict_features(grid, none, "area", "start", "severity", "composite").select("conflict_persistence").collect()} == {0.0}
    for r in P.add_conflict_features(grid, events, "area", "start", "severity", "composite", days=0.1).collect():
        on_day = sum(e[1] == r["panel_date"] for e in EVENTS if e[0] == r["area"])
        assert r["conflict_persistence"] == pytest.approx(on_day, abs=2e-3)


def test_static_and_monthly(spark, grid):
    rows = spark.createDataFrame([("a", 1.0, 2), ("a", 2.5, 1), (None, 9.0, 3)], "k string, v double, o int")
    out = P.add_static_count(P.add_static_sum(P.add_static_first(grid, rows.withColumnRenamed("k", "area").withColumnRenamed("v", "first_v"), "area", "o", ["first_v"]), rows, "area", "k", "v", "total"), rows, "area", "k", "n")
    a = out.filter("area = 'a'").first()
    c = out.filter("area = 'c'").first()
    assert (a["first_v"], a["total"], a["n"]) == (2.5, 3.5, 2) and (c["first_v"], c["total"], c["n"]) == (None, 0.0, 0)
    monthly = spark.createDataFrame([("a", 2020, 2, 1.0), ("a", 2020, 2, 3.0)], "k string, y int, m int, v double")
    got = P.add_monthly_means(grid, monthly, "area", "k", F.col("y"), F.col("m"), {"v": F.col("v")})
    assert {r["v"] for r in got.collect()} == {None, 2.0} and got.count() == grid.count()
