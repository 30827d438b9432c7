"""Rows that a model cannot tell apart: counted once for all folds, scored once, and the same figures as row by row."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_trees import table

from lodgemetrics.functions.distribution import describe_by, percentiles_by
from lodgemetrics.operators import boosting, models, policy, trees


def test_bins_in_spark_are_those_of_numpy(spark):
    inf = float("inf")
    x = [None, float("nan"), -inf, -2.5, -0.0, 0.0, 1.0, 1.5, 2.0, 7.0, inf]
    rows = [("abcd"[i % 3] if i % 4 else None, v, float(i), None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "kind string, x double, i double, none double")
    binner = trees.Binner(["kind"], ["x", "i", "none"] + ["i"] * 6, [["b", "a"]],
                          [np.array([-inf, 0.0, 1.0, 2.0, inf]), np.arange(9.0), np.zeros(0), *[np.array([float(j)]) for j in range(6)]])
    want = binner.bins(np.array(df.select(binner.features().alias("f")).toPandas()["f"].tolist()))
    words = binner.packed(df, []).toPandas()[trees.keys(10)].to_numpy()
    got = np.ascontiguousarray(words).astype("<i8").view(np.uint8).reshape(len(x), -1)[:, :10]
    assert np.array_equal(got, want)


def test_points_keep_ranks():
    rng = np.random.default_rng(5)
    x = np.where(rng.random(40_000) < 0.3, 1.0, rng.normal(size=40_000))
    whole = trees._points(x, np.ones(len(x), np.int64), 1 << 20)
    assert np.array_equal(whole[0], np.unique(x)) and whole[1].sum() == len(x)
    few = trees._points(x, np.ones(len(x), np.int64), 500)
    probs = [i / 62 for i in range(1, 62)]
    assert len(few[0]) <= 500 and few[1].sum() == len(x)
    assert np.array_equal(trees._quantiles(*whole, probs), np.sort(x)[np.ceil(np.array(probs) * len(x)).astype(int) - 1])
    for q, v in zip(probs, trees._quantiles(*few, probs)):
        assert (x < v).mean() - 1 / 500 <= q <= (x <= v).mean() + 1 / 500


def test_edges_and_levels_are_exact_whatever_the_lots(spark):
    df, rows = table(spark, 900, parts=6)
    one, lots = (trees.fit_bins(df, ["kind"], ["x", "z"], lot=n) for n in (64, 2))
    z = np.sort([r[3] for r in rows])
    assert np.array_equal(one.edges[1], np.unique(z[np.ceil(np.arange(1, 62) / 62 * 900).astype(int) - 1]))
    assert one.levels == lots.levels and all(np.array_equal(a, b) for a, b in zip(one.edges, lots.edges))


def test_equal_rows_of_all_folds_are_one_row(spark):
    df, rows = table(spark, 400)
    binner = trees.fit_bins(df, ["kind"], ["x"])
    got = trees.collapsed(df, binner, "y", F.pmod("id", F.lit(3)).cast("int"), 3).collect()
    assert len(got) == len({r["k0"] for r in got}) < 130
    for name, y in (("n0", 0), ("n1", 1)):
        assert [sum(r[name][f] for r in got) for f in range(3)] == [sum(r[4] == y and r[0] % 3 == f for r in rows) for f in range(3)]


def test_counted_rows_score_like_single_ones(spark):
    df, _ = table(spark, 500)
    fold = F.pmod("id", F.lit(3)).cast("int")
    grid = [(2, 2), (3, 4)]
    cv = trees.fit_forest(df, ["kind"], ["x"], "y", trees=3, depth=4, least=5, folds=3, fold=fold)
    single = cv.scored(df.withColumn("fold", fold), ["a", "b"], grid, F.col("fold"))
    counted = cv.counted(df, "y", ["a", "b"], grid, "n")
    assert counted.count() < 350 and counted.agg(F.sum("n")).first()[0] == 500
    for c in "ab":
        want = {r["fold"]: r for r in policy.roc_auc(single, c, "y", by=["fold"]).collect()}
        for r in policy.roc_auc(counted, c, "y", by=["fold"], weight="n").collect():
            assert r["positives"] == want[r["fold"]]["positives"] and np.isclose(r["roc_auc"], want[r["fold"]]["roc_auc"])
        assert policy.confusion_at(counted, 0.4, c, "y", weight="n").first() == policy.confusion_at(single, 0.4, c, "y").first()


def test_a_forest_of_lent_rows_is_the_same(spark):
    df, _ = table(spark, 400)
    ask = dict(trees=3, depth=4, least=5)
    cv = trees.fit_forest(df, ["kind"], ["x"], "y", folds=3, fold=F.pmod("id", F.lit(3)).cast("int"), **ask)
    one, lent = trees.fit_forest(df, ["kind"], ["x"], "y", **ask), trees.fit_forest(df, ["kind"], ["x"], "y", like=cv, **ask)
    assert all(np.array_equal(a, b) for a, b in zip(one.forest[1:], lent.forest[1:]))


def test_boosted_rows_score_like_single_ones(spark):
    df, _ = table(spark, 500)
    new, _ = table(spark, 300, seed=8)
    model = boosting.fit_boosted(df, ["kind"], ["x"], "y", rounds=4, depth=3)
    for rows in (df, new):
        counted = model.counted(rows, "y", "p", "n")
        assert counted.count() < 160
        assert policy.confusion_at(counted, 0.4, "p", "y", weight="n").first() == policy.confusion_at(model.transform(rows), 0.4, "p", "y").first()


def test_calibration_of_counted_rows(spark, make):
    rng = np.random.default_rng(1)
    lead = rng.integers(0, 40, 300)
    train = models.booking_features(make([{"lead_time": int(t), "is_canceled": int(rng.random() < t / 40)} for t in lead]))
    model = models.fit_rf(train, trees=3, depth=3, least=5)
    tables = []
    for weight in (None, "n"):
        p = models.predict(model, train, weight=weight)
        tables.append(policy.calibration_table(models.calibrate_isotonic(p, p, weight=weight), "p_cal", weight=weight).orderBy("bin").collect())
    assert len(tables[0]) == len(tables[1]) > 2 and all(np.allclose(tuple(a), tuple(b)) for a, b in zip(*tables))


def test_two_readings_give_the_exact_percentiles(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v)) for k, v in zip(rng.choice(["a", "b"], 700), rng.random(700))] + [(None, 0.5), (None, 0.25), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"low": 0.2, "high": 0.9}
    want = {r["g"]: (r["low"], r["high"]) for r in describe_by(df, ["g"], "v", probs, width=1e-4).collect()}
    got = {r["g"]: (r["low"], r["high"]) for r in percentiles_by(df, ["g"], "v", probs, width=1e-4).collect()}
    assert set(got) == {"a", "b", None} and all(np.allclose(got[g], want[g]) for g in want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_a_split_is_found_once(spark):
    from lodgemetrics.plans import policy_queries
    from lodgemetrics.plans.catalog import Inputs

    for rows in policy_queries._train_test(Inputs(spark, "/root/testdata/sf0.001")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "Window" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("mean", [65, 100, 5000])
def test_large_means_are_drawn_from_a_table(mean):
    key = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = trees.redrawn(np.full(20_000, mean), key)
    assert abs(drawn.mean() - mean) < 0.02 * mean and abs(drawn.var() - mean) < 0.1 * mean
    assert len(trees._normal()) == 2 ** 16
