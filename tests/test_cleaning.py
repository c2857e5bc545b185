import datetime as dt
import math

from pyspark.sql import functions as F

from panelyard.functions import cleaning as C
from panelyard.functions import labels as L


def test_dates(spark):
    raw = ["3/1/2016", "03/01/2016", "1/1/2010", "13/45/2010", "", None]
    df = spark.createDataFrame([(i, a, "6/1/2010") for i, a in enumerate(raw)], "id int, Date_Start string, Date_End string")
    got = C.parse_dates(df).orderBy("id").collect()
    assert [r["Date_Start_parsed"] for r in got] == [dt.date(2016, 3, 1)] * 2 + [dt.date(2010, 1, 1)] + [None] * 3
    assert [r["date_precision_suspect"] for r in got] == [False, False, True, False, False, False]
    assert got[0]["duration_days"] == (dt.date(2010, 6, 1) - dt.date(2016, 3, 1)).days
    failed = {r["column"]: r["failed"] for r in C.failed_dates(df, ["Date_Start", "Date_End"]).collect()}
    assert failed == {"Date_Start": 2, "Date_End": 0}


def test_suspect_dates_are_kept_unless_asked(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "date_precision_suspect boolean")
    assert C.without_suspect_dates(df).count() == 3
    assert C.without_suspect_dates(df, exclude=True).count() == 2


def test_counts_and_severity(spark):
    raw = ["0", "69+", "5,000+", "Unknown", "\tunknown\n", "", None, "nan"]
    df = spark.createDataFrame([(i, c, "Unknown") for i, c in enumerate(raw)], "id int, Casualties_Reported string, Displaced_Persons string")
    rows = C.clean_counts(df).withColumn("s", C.severity()).orderBy("id").collect()
    assert [r["Casualties_Reported_numeric"] for r in rows] == [0.0, 69.0, None, None, None, None, None, None]
    assert [r["Casualties_Reported_is_lower_bound"] for r in rows] == [False, True, True, False, False, False, False, False]
    assert [r["Casualties_Reported_is_unknown"] for r in rows] == [False, False, False, True, True, False, False, False]
    # only two flagged unknowns leave no severity; a missing count is not unknown
    assert [r["s"] is None for r in rows] == [False, False, False, True, True, False, False, False]
    assert math.isclose(rows[1]["s"], math.log1p(69))
    strict = C.clean_counts(df, missing_is_unknown=True).withColumn("s", C.severity()).orderBy("id").collect()
    assert strict[6]["s"] is None


def test_composite(spark):
    df = spark.createDataFrame(
        [(200, None), (180, "a Long Running row"), (None, "LONG-TERM"), (3, "short")], "duration_days int, Notes string"
    )
    got = [tuple(r)[2:] for r in C.flag_composite(df).collect()]
    assert got == [(True, False, True), (False, True, True), (False, True, True), (False, False, False)]


def test_double_encoding_is_undone(spark):
    good = ["café — río", "plain", "naïve", None, "日本"]
    bad = [g and g.encode().decode("latin-1") for g in good[:3]] + [None, "日本"]
    twice = "é".encode().decode("latin-1").encode().decode("latin-1")
    df = spark.createDataFrame([(b,) for b in [*bad, twice]], "Notes string")
    assert [r[0] for r in C.repair_text(df).collect()] == [*good, "é"]
    assert C.repaired_count(df, ["Notes"]).first()["changed"] == 3


def test_map_labels(spark):
    df = spark.createDataFrame([("Lower", 20.0), ("High", None), (None, 5.0)], "c string, s double")
    got = [tuple(r) for r in df.select(L.map_risk_label(F.col("c")), L.heat_weight(F.col("s"))).collect()]
    assert got == [("Low", 1.0), ("High", 0.4), ("No data", 0.5)]
