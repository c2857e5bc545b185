import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators.ordering import exact_quantiles, numbered, running_totals


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = [("hot" if i % 3 else f"g{i % 5}", float(round(v, 2)), i) for i, v in enumerate(rng.normal(0, 1, 500))]
    return spark.createDataFrame(data + [("hot", None, 900)], "g string, v double, id long").repartition(7), data


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_a_plain_sort(rows, descending):
    df, data = rows
    got = {
        (r["g"], r["v"]): (r["n"], r["cum_n"], r["all_n"])
        for r in running_totals(df, "v", {"n": F.lit(1)}, ["g"], descending).collect()
    }
    for g in {d[0] for d in data}:
        values = [d[1] for d in data if d[0] == g]
        for v in set(values):
            cum = sum(x >= v if descending else x <= v for x in values)
            assert got[g, v] == (values.count(v), cum, len(values))


def test_running_totals_survive_one_repeated_value(spark):
    df = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)], "v double")
    got = sorted(tuple(r) for r in running_totals(df, "v", {"n": F.lit(1)}).collect())
    assert got == [(1.0, 50, 50, 51), (2.0, 1, 51, 51)]


def test_numbered_is_dense_per_group(rows):
    df, data = rows
    got = {r["id"]: r["rn"] for r in numbered(df, "id", "rn", ["g"]).collect()}
    for g in {d[0] for d in data}:
        ids = sorted(i for gg, _, i in data + [("hot", None, 900)] if gg == g)
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


@pytest.mark.parametrize("parts", [2, 9])
def test_quantiles_interpolate_linearly(spark, rows, parts):
    df, data = rows
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    for r in exact_quantiles(df, "v", probs, ["g"]).collect():
        want = np.quantile([d[1] for d in data if d[0] == r["g"]], probs)
        assert np.allclose(r["quantiles"], want, atol=1e-12)


def test_dates_can_be_ordered(spark):
    df = spark.sql("select date_add(date'2020-01-01', cast(id % 17 as int)) d, id from range(100)")
    last = running_totals(df, "d", {"n": F.lit(1)}).orderBy("d").collect()[-1]
    assert last["cum_n"] == 100
