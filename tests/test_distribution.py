import numpy as np
import pytest

from lodgemetrics.functions.distribution import describe_by, ranked_counts, ranked_rows, value_counts


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in np.round(rng.gamma(2, 50, 3000), 2)]
    rows += [("hot", 42.0)] * 1500 + [("one", 5.0)] + [("two", 1.0), ("two", 4.0)] + [("neg", float(v)) for v in (-3.5, -1, 0, 2)]
    return rows, spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize("width", [0.1, 1.0, 1000.0])
def test_percentiles_match_numpy(sample, width):
    rows, df = sample
    got = {r.g: r for r in describe_by(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.99}, width).collect()}
    for g in {r[0] for r in rows}:
        v = np.array([x for k, x in rows if k == g])
        assert np.allclose([got[g].a, got[g].b, got[g].c], np.percentile(v, [5, 50, 99]))
        assert (got[g].n, got[g].min, got[g].max) == (len(v), v.min(), v.max())
        assert np.isclose(got[g]["mean"], v.mean())
        assert got[g]["std"] is None if len(v) == 1 else np.isclose(got[g]["std"], v.std(ddof=1))


def test_whole_table_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    r = describe_by(df, [], "v", {"m": 0.5}).first()
    assert (r.n, r.m) == (2, 2.0)


def test_midranks(sample):
    rows, df = sample
    got = {r._value: r._midrank for r in ranked_counts(value_counts(df, ["g"], "v"), ["g"]).where("g = 'hot'").collect()}
    v = np.array([x for k, x in rows if k == "hot"])
    for x in (42.0, v.min(), v.max()):
        assert got[x] == (v < x).sum() + ((v == x).sum() + 1) / 2


def test_ranked_rows_is_a_row_number(sample):
    rows, df = sample
    got = ranked_rows(df, ["g"], "v", [], "rank", width=10.0).where("g = 'hot'").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert [r.v for r in got] == sorted(x for k, x in rows if k == "hot")


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    assert {r.g: r.m for r in describe_by(df, ["g"], "v", {"m": 0.5}).collect()} == {None: 2.0, "a": 5.0}
    assert ranked_rows(df, ["g"], "v", []).count() == 3


def test_null_order_value_is_ranked_first(spark):
    df = spark.createDataFrame([("a", None), ("a", 3.0), ("a", -5.0)], "g string, v double")
    assert [(r.v, r["rank"]) for r in ranked_rows(df, ["g"], "v", []).orderBy("rank").collect()] == [(None, 1), (-5.0, 2), (3.0, 3)]
