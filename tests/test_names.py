import random

import pytest
from pyspark.sql import functions as F

from panelyard.functions import names as N
from panelyard.functions import similarity as S

AREAS = [("Machakos", "Athi River"), ("Machakos", "Kathiani"), ("Nairobi", "Lang'ata"), ("Nairobi", "Westlands"), ("Kiambu", "Kiambu"), ("Turkana", "Turkana West")]


def dp_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence_equals_dynamic_programming():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd é", k=rng.randint(0, 90))) for _ in range(2))
        assert S.common_subsequence(a, b) == dp_lcs(a, b)


def test_ratios():
    assert S.ratio("", "") == 100 and S.ratio("ab", "") == 0
    assert S.token_sort("river athi", "athi river") == 100
    assert S.token_set("athi river town", "athi river") == 100
    assert S.partial("river", "the athi river bank") == 100
    assert S.weighted_ratio("athi river", "athi rivr") > 90
    assert S.weighted_ratio("", "x") == 0


def test_normalize(spark):
    raw = ["ATHI RIVER", "Athi-River ", "Lang'ata", "langata", "Éldorèt 7!", "  ", None, "Kiambu  West"]
    df = spark.createDataFrame([(r,) for r in raw], "n string")
    got = [r[0] for r in df.select(N.normalize_name(F.col("n"))).collect()]
    assert got == ["athi river", "athi river", "lang'ata", "lang'ata", "eldoret", "", "", "kiambu"]


@pytest.mark.parametrize("max_listed", [100, 1])
def test_matching(spark, max_listed):
    canonical = N.canonical_areas(spark.createDataFrame([*AREAS, ("Mombasa", "Nyali")], "County string, SubCounty string"))
    cases = [
        ("ATHI-RIVER", "Machakos", "Athi River", "exact"),
        ("Athi Rivr", "machakos", "Athi River", "fuzzy"),
        ("langata", None, "Lang'ata", "exact"),
        ("Westlnds", "Nowhere", "Westlands", "fuzzy"),
        ("Zzzz", "Nairobi", None, "unmatched"),
        ("", "Nairobi", None, "unmatched"),
        (None, None, None, "unmatched"),
        ("Turkana West", "Nairobi", None, "unmatched"),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "id int, raw string, hint string")
    got = N.match_areas(df, "raw", canonical, "hint", max_listed=max_listed).orderBy("id").collect()
    assert [(r["matched_subcounty"], r["match_method"]) for r in got] == [c[2:] for c in cases]
    assert got[0]["match_score"] == 100 and got[5]["match_score"] == 0
    assert got[7]["match_score"] < 80


def test_report_and_missing(spark):
    canonical = N.canonical_areas(spark.createDataFrame(AREAS, "County string, SubCounty string"))
    df = spark.createDataFrame([("Kathiani",), ("Kathiani",), ("??",)], "raw string")
    matched = N.match_areas(df, "raw", canonical)
    assert {(r["match_method"], r["n"]) for r in N.match_report(matched).collect()} == {("exact", 2), ("unmatched", 1)}
    assert N.areas_without_match(canonical, matched).count() == len(AREAS) - 1


def test_early_exit_only_when_out_of_reach():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 200))) for _ in range(2))
        true = dp_lcs(a, b)
        assert S.common_subsequence(a, b, true) == true
        assert S.common_subsequence(a, b, true + 1) in (-1, true)
