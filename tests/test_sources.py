import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from panelyard import session
from panelyard.functions import drafts as D
from panelyard.operators import forecast as G
from panelyard.operators import serve as V
from panelyard.sources import tables as S
from panelyard.streaming import flows as W


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,v\nLang’ata,1\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("name,v\nLang’ata – café,2\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes(b"name,v\ncaf\xe9\x81,3\n")
    got = {r["v"]: r["name"] for r in S.read_csv_robust(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {"1": "Lang’ata", "2": "Lang’ata – café", "3": "café\x81"}


def test_typed_csv_keeps_broken_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,day,v\n1,2020-01-02,1.5\nx,2020-01-03,2\n")
    rows = S.read_typed_csv(spark, str(tmp_path / "t.csv"), "id int, day date, v double").collect()
    assert rows[0]["day"] == dt.date(2020, 1, 2) and rows[0]["_corrupt"] is None
    assert rows[1]["id"] is None and rows[1]["_corrupt"] == "x,2020-01-03,2"


def boundaries(crs):
    ring = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    feature = lambda a, kind, c: {"type": "Feature", "properties": {"COUNTY": "C", "SUBCOUNTY": a}, "geometry": {"type": kind, "coordinates": c}}
    doc = {"type": "FeatureCollection", "features": [feature("p", "Polygon", [ring]), feature("m", "MultiPolygon", [[ring], [ring]])]}
    if crs:
        doc["crs"] = {"type": "name", "properties": {"name": crs}}
    return json.dumps(doc, indent=1)


def test_boundaries(spark, tmp_path):
    path = tmp_path / "b.geojson"
    path.write_text(boundaries("urn:ogc:def:crs:OGC:1.3:CRS84"))
    rows = S.read_boundaries(spark, str(path), "COUNTY", "SUBCOUNTY").collect()
    assert sorted((r["area_id"], r["ring"]) for r in rows) == [("C|m", 0), ("C|m", 1), ("C|p", 0)] and len(rows[0]["points"]) == 5
    assert S.read_boundaries(spark, str(path), "COUNTY", "SUBCOUNTY", counties=["D"]).count() == 0
    path.write_text(boundaries(None))
    with pytest.raises(ValueError):
        S.read_boundaries(spark, str(path), "COUNTY", "SUBCOUNTY")
    assert S.read_boundaries(spark, str(path), "COUNTY", "SUBCOUNTY", crs="EPSG:4326").count() == 3
    with pytest.raises(ValueError):
        S.read_boundaries(spark, str(path), "COUNTY", "SUBCOUNTY", crs="EPSG:32737")


def test_url_list_and_items(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# mine\n\n https://a.org/x \nhttps://b.org\n")
    assert [r["url"] for r in S.read_url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a.org/x", "https://b.org"]
    (tmp_path / "items").mkdir()
    (tmp_path / "items" / "1.json").write_text('{"url": "u", "title": "t", "discovered_via": "rss"}\n')
    assert S.read_items(spark, str(tmp_path / "items")).first()["title"] == "t"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, True, 3, float("nan")), (2, None, 6, 1.5)], "id int, flag boolean, horizon_months int, v double")
    path = S.write_step(df, str(tmp_path), "step")
    assert spark.read.parquet(path).count() == 2
    S.write_by_horizon(df, str(tmp_path / "h"))
    assert sorted(p for p in os.listdir(tmp_path / "h") if "=" in p) == ["horizon_months=3", "horizon_months=6"]
    one = S.read_horizon(spark, str(tmp_path / "h"), 3, [3, 6])
    assert one.count() == 1 and "PartitionFilters: [isnotnull(horizon_months" in one._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        S.read_horizon(spark, str(tmp_path / "h"), 1, [3, 6])
    S.write_split(df, "flag", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("flag = false").count() == 1
    assert [r["json"] for r in S.json_records(df.select("id", "v")).orderBy("json").collect()] == ['{"id":1,"v":null}', '{"id":2,"v":1.5}']


def test_geojson(spark, tmp_path):
    df = spark.sql("select 'a' as n, double('nan') as p, date'2020-01-01' as d, array(array(struct(1D as x, 2D as y))) as g union all select 'b', 0.5D, null, null")
    S.write_geojson(df, "g", str(tmp_path / "g"))
    got = sorted((json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "g")).collect()), key=lambda f: f["properties"]["n"])
    assert got[0] == {"type": "Feature", "properties": {"n": "a", "p": None, "d": "2020-01-01"}, "geometry": {"type": "Polygon", "coordinates": [[[1.0, 2.0]]]}}
    assert got[1]["geometry"] is None


def test_model_folder(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), int(i > 5), 1.0) for i in range(12)], "x double, label int, weight double")
    model = G.logistic(["x"], 12).fit(rows)
    S.save_model(spark, model, str(tmp_path / "m"), horizon_months=3, threshold=0.4, features=["x"])
    back, facts = S.load_model(spark, str(tmp_path / "m"))
    assert facts["threshold"] == 0.4 and facts["features"] == ["x"]
    assert G.score_rows(back, rows).select("score").collect() == G.score_rows(model, rows).select("score").collect()


# --- serving -----------------------------------------------------------------------------------

def test_incident_filters(spark):
    rows = [("r1", "N", "3/1/2016", "Mathare flood", None, 1), ("r2", "N", "bad", "x", "MATHARE", 1), ("r3", "K", "3/1/2017", "100%", None, 2)]
    df = spark.createDataFrame(rows, "Record_ID string, geo_county string, Date_Start string, Incident_Summary string, NLP_Keywords string, topic_id int")
    ids = lambda **k: [r["Record_ID"] for r in V.query_incidents(df, **k).orderBy("Record_ID").collect()]
    assert ids() == ["r1", "r2", "r3"] and ids(year_min=2000) == ["r1", "r3"] and ids(county="N", year_max=2020) == ["r1"]
    assert ids(search="mathare") == ["r1", "r2"] and ids(search="0%") == ["r3"] and ids(search="nan") == [] and ids(search="R3") == ["r3"]
    assert ids(topic_id=2) == ["r3"] and ids(domain="Mixed") == ["r1", "r2", "r3"]
    with pytest.raises(ValueError):
        V.page(df, ["Record_ID"], 6000)


def test_chart_tables(spark):
    df = spark.sql("select date'2020-02-03' as d, 2.0D as s union all select date'2020-02-04', null union all select null, 9.0D")
    assert [tuple(r) for r in V.counts_by_year(df, F.col("d"), "s").collect()] == [(2020, 2, 2.0)]
    months = V.counts_by_month(df, F.col("d")).orderBy("month").collect()
    assert len(months) == 12 and months[1]["count"] == 2 and months[0]["month_label"] == "Jan" and months[0]["count"] == 0
    empty = V.panel_summary(spark.createDataFrame([], "conflict_onset boolean, conflict_persistence double")).first()
    assert empty["total_months"] == 0 and empty["avg_persistence"] is None


def test_extent_precedence(spark):
    areas = spark.createDataFrame([("a", "C", 0.0, 1.0), ("b", "C", 5.0, 6.0)], "area string, county string, lon double, lat double")
    points = spark.createDataFrame([(2.0, 2.0), (3.0, 3.0)], "lon double, lat double")
    box = lambda **k: tuple(V.selection_extent(areas, points, "lon", "lat", **k).first())
    assert box(area="b", county="C") == (5.0, 5.0, 6.0, 6.0) and box(county="C") == (0.0, 5.0, 1.0, 6.0)
    assert box(filtered=F.col("lon") > 2.5) == (3.0, 3.0, 3.0, 3.0) and box() == (0.0, 5.0, 1.0, 6.0)


# --- streams ------------------------------------------------------------------------------------

def write_batch(path, name, rows):
    (path / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_candidate_stream_keeps_urls_once(spark, tmp_path):
    item = lambda u, t, via="rss": {"url": u, "title": t, "snippet": "", "source_name": "", "discovered_via": via}
    write_batch(tmp_path, "1", [item("u1", "Eviction in Nairobi"), item("u2", "nothing"), item("u1", "again eviction Nairobi"), item("", "eviction Nairobi")])
    write_batch(tmp_path, "2", [item("u1", "eviction Kiambu"), item("u3", "x", "manual")])
    stream = S.read_items(spark, str(tmp_path), stream=True).withColumn("seen", F.lit("2024-01-01").cast("timestamp"))
    got = W.drain(W.candidate_stream(stream, "seen"), "t")
    assert sorted((r["url"], r["manual_override"]) for r in got.collect()) == [("u1", False), ("u3", True)]


def test_counts_take_late_rows(spark, tmp_path):
    row = lambda day: {"area": "a", "at": f"{day} 00:00:00"}
    write_batch(tmp_path, "1", [row("2024-01-05"), row("2024-02-20")])
    write_batch(tmp_path, "2", [row("2024-01-30"), row("2024-03-01")])
    write_batch(tmp_path, "3", [row("2024-05-02")])
    # later than the watermark: not counted again
    write_batch(tmp_path, "4", [row("2024-01-02"), row("2024-04-30")])
    for k in range(1, 5):
        os.utime(tmp_path / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("area string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    got = W.drain(W.period_counts(stream, "area", "at"), "c")
    assert sorted((str(r["period_start"])[:7], r["n_events"]) for r in got.collect()) == [("2024-01", 2), ("2024-02", 1), ("2024-03", 1)]


# --- session ------------------------------------------------------------------------------------

def test_checkpoint_folder_is_the_named_one(spark, tmp_path, monkeypatch):
    root = session.shared_root(spark)
    assert os.path.isdir(root) or root.startswith("file:")
    assert session.checkpointed(spark.range(5)).count() == 5
    assert session.fits(spark.range(5), 5) and not session.fits(spark.range(6), 5)


def test_page_text(spark):
    html = "<head><title>a</title></head><body><script>x('<p>')</script><p>One&nbsp;&lt;two&gt;</p>\n<!-- no --><b>three</b></body>"
    assert spark.createDataFrame([(html,)], "h string").select(D.page_text(F.col("h"))).first()[0] == "One <two> three"
