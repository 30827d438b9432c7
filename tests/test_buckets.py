"""Buckets of rank statistics: how full the fullest is, and that results do not depend on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgemetrics.functions import distribution as D
from lodgemetrics.operators import adr, cancel, policy
from lodgemetrics.operators import stats as T

N = 20_000
COLUMNS = {"unit": lambda r: r.random(N), "wide": lambda r: r.random(N) * 1e12 - 4e11, "tiny": lambda r: r.random(N) * 1e-9,
           "band": lambda r: 1e9 + r.random(N), "skewed": lambda r: r.exponential(50, N)}


def column(spark, name):
    rng = np.random.default_rng(len(name))
    v = COLUMNS[name](rng)
    rows = list(zip(v.tolist(), rng.integers(0, 2, N).tolist(), rng.choice(["a", "b"], N).tolist()))
    return spark.createDataFrame(rows, "adr double, y int, g string"), v


def fullest(df, width):
    counts = D.value_counts(df, [], "adr", width)
    return counts.groupBy("_bucket").agg(F.sum("_cnt").alias("n")).agg(F.max("n")).first()[0] / N


@pytest.mark.parametrize("name", list(COLUMNS))
def test_no_bucket_is_too_full(spark, name):
    df, _ = column(spark, name)
    shares = (fullest(df, None), fullest(df, D.equi_depth(df, "adr", 1 / 100)))
    assert shares[1] < 0.013
    assert name == "band" or shares[0] < 0.02  # a narrow band far from zero needs edges from the data


@pytest.mark.parametrize("share", [None, 1 / 50])
@pytest.mark.parametrize("name", ["unit", "wide", "band"])
def test_statistics_do_not_depend_on_buckets(spark, name, share):
    df, v = column(spark, name)
    rows = df.toPandas()
    box = {r["g"]: r for r in cancel.boxplot_stats(df, ["g"], share=share).collect()}
    spread = {r["g"]: r for r in adr.adr_stats_by(df, ["g"], share=share).collect()}
    for g in "ab":
        own = rows.loc[rows.g == g, "adr"]
        assert np.isclose(box[g]["median"], np.quantile(own, 0.5), rtol=1e-12)
        if name != "band" or share:  # digits of a spread far below the values are told by fitting buckets only
            assert np.isclose(spread[g]["std"], own.std(), rtol=1e-6)
    got = T.mann_whitney(df, "adr", "y", share=share).first()
    zero = rows.adr[rows.y == 0].to_numpy()
    rank = rows.adr.rank().to_numpy()[rows.y == 0]
    assert np.isclose(got["u_stat"], rank.sum() - len(zero) * (len(zero) + 1) / 2)
    auc = policy.roc_auc(df, "adr", "y", share=share).first()["roc_auc"] if share else None
    assert auc is None or np.isclose(auc, 1 - got["u_stat"] / (len(zero) * (N - len(zero))))
    rho = T.spearman_vs(df, "y", ["adr"], share=share).first()["spearman"]
    assert np.isclose(rho, np.corrcoef(rows.adr.rank(), rows.y.rank())[0, 1])


def test_buckets_rise_with_values(spark):
    v = sorted([0.0, -0.0, 1e-300, -1e-300, 5e-324, 1.0, -1.0, 2.0, 1.9999999999999998, 4.0, 3.9999999999999996, 1e308, -1e308,
                float("inf"), float("-inf"), 0.1, 0.5, 127.0, 128.0, 365.0])
    df = spark.createDataFrame([(x,) for x in v] + [(None,), (float("nan"),)], "v double")
    for width in (None, [], [1.0, 2.0, 128.0]):
        got = df.select("v", D.bucket_of(F.col("v"), width).alias("b")).collect()
        assert got[-2]["b"] is None
        b = [r["b"] for r in got[:-2]]
        assert b == sorted(b) and b[-1] <= got[-1]["b"]
    edges = df.where("v IS NOT NULL AND abs(v) < 1e307 AND NOT isnan(v) AND (v = 0 OR abs(v) > 1e-301)").select("v", D.edge_of(D.bucket_of(F.col("v"))).alias("e")).collect()
    assert all(abs(r["e"]) <= abs(r["v"]) <= abs(r["e"]) * (1 + 1 / 64) + 1e-320 for r in edges)
    assert D.equi_depth(df.limit(0), "v") == []
