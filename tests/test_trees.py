"""Histogram forests against a single-node exact tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgemetrics.operators import models, trees
from lodgemetrics.operators.policy import roc_auc


def table(spark, n, seed=3, parts=5):
    rng = np.random.default_rng(seed)
    kind = rng.choice(["a", "b", "c", "d"], n, p=[0.55, 0.25, 0.15, 0.05])
    x, z = rng.integers(0, 40, n), rng.normal(size=n).round(3)
    logit = 0.08 * (x - 20) + np.where(kind == "b", 1.5, np.where(kind == "d", 1.0, -0.5)) + 0.7 * z * (x > 15)
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    rows = list(zip(range(n), kind.tolist(), x.tolist(), z.tolist(), y.tolist()))
    return spark.createDataFrame(rows, "id long, kind string, x int, z double, y int").repartition(parts), rows


def exact_tree(x, y, category, depth, least, w):
    """Rates of class 1 of each row by greedy Gini splits; category columns are ordered by their rate."""
    out = np.empty(len(y))

    def gini(s):
        a, b = (y[s] == 0).sum() * w[0], (y[s] == 1).sum() * w[1]
        return b * b / (a + b) if a + b else 0.0

    def go(s, d):
        out[s] = (y[s] == 1).sum() * w[1] / ((y[s] == 0).sum() * w[0] + (y[s] == 1).sum() * w[1])
        if d == 0 or len(s) < 2 * least or len(set(y[s])) < 2:
            return
        best = (1e-9 * (np.where(y[s] == 1, w[1], w[0]).sum()), None)
        for f in range(x.shape[1]):
            v = x[s, f]
            if category[f]:
                levels = sorted(set(v), key=lambda k: ((y[s][v == k] == 1).sum() * w[1] / np.where(y[s][v == k] == 1, w[1], w[0]).sum(), k))
                v = np.array([levels.index(k) for k in v])
            for cut in np.unique(v)[:-1]:
                a, b = s[v <= cut], s[v > cut]
                gain = gini(a) + gini(b) - gini(s)
                if min(len(a), len(b)) >= least and gain > best[0] + 1e-9:
                    best = (gain, (a, b))
        if best[1]:
            for part in best[1]:
                go(part, d - 1)

    go(np.arange(len(y)), depth)
    return out


def auc(score, y):
    order = np.argsort(np.argsort(score)) * 1.0
    pairs = [(p > q) + 0.5 * (p == q) for p in score[y == 1] for q in score[y == 0]]
    return float(np.mean(pairs)) if pairs else order.mean()


def test_one_tree_is_the_exact_tree(spark):
    df, rows = table(spark, 600)
    df = df.drop("z")
    model = trees.fit_forest(df, ["kind"], ["x"], "y", trees=1, depth=4, least=15, tried=2, bootstrap=False)
    got = dict(model.transform(df).select("id", "p").collect())
    y = np.array([r[4] for r in rows])
    x = np.array([["abcd".index(r[1]), r[2]] for r in rows])
    w = (len(y) / 2 / (y == 0).sum(), len(y) / 2 / (y == 1).sum())
    want = exact_tree(x, y, [True, False], 4, 15, w)
    assert np.allclose([got[r[0]] for r in rows], want)


def test_forest_beats_the_exact_tree_on_new_rows(spark):
    train, rows = table(spark, 1500, seed=4)
    test, held = table(spark, 800, seed=5)
    model = trees.fit_forest(train, ["kind"], ["x", "z"], "y", trees=40, depth=6, least=10)
    forest = roc_auc(model.transform(test), label="y").first()["roc_auc"]
    x = np.array([["abcd".index(r[1]), r[2], r[3]] for r in rows])
    y = np.array([r[4] for r in rows])
    # an exact tree told apart on the held rows by growing it on both, the held ones without weight in the splits
    w = (len(y) / 2 / (y == 0).sum(), len(y) / 2 / (y == 1).sum())
    own = exact_tree(x, y, [True, False, False], 4, 25, w)
    single = trees.fit_forest(train, ["kind"], ["x", "z"], "y", trees=1, depth=4, least=25, tried=3, bootstrap=False)
    binned = np.array([r["p"] for r in single.transform(train).orderBy("id").select("p").collect()])
    assert abs(auc(own, y) - auc(binned, y)) < 0.01
    one = roc_auc(single.transform(test), label="y").first()["roc_auc"]
    assert forest > one - 0.005 and forest > 0.75


def test_repeatable_and_free_of_layout(spark):
    df, _ = table(spark, 700)
    a = trees.fit_forest(df, ["kind"], ["x", "z"], "y", trees=6, depth=5, seed=1)
    b = trees.fit_forest(df.repartition(2), ["kind"], ["x", "z"], "y", trees=6, depth=5, seed=1)
    c = trees.fit_forest(df, ["kind"], ["x", "z"], "y", trees=6, depth=5, seed=2)
    assert all(np.array_equal(x, y) for x, y in zip(a.forest[1:], b.forest[1:]))
    assert not np.array_equal(a.forest.feature, c.forest.feature)


def test_smaller_forests_are_part_of_larger_ones(spark):
    df, _ = table(spark, 500)
    large = trees.fit_forest(df, ["kind"], ["x"], "y", trees=5, depth=6, least=5)
    small = trees.fit_forest(df, ["kind"], ["x"], "y", trees=3, depth=4, least=5)
    got = large.scored(df, ["s"], [(3, 4)]).select("id", "s").orderBy("id").collect()
    want = small.transform(df, "s").select("id", "s").orderBy("id").collect()
    assert [r["id"] for r in got] == [r["id"] for r in want]
    assert np.allclose([r["s"] for r in got], [r["s"] for r in want])


def test_folds_do_not_see_their_rows(spark):
    df, _ = table(spark, 600)
    fold = F.pmod("id", F.lit(3)).cast("int")
    cv = trees.fit_forest(df, ["kind"], ["x"], "y", trees=2, depth=3, folds=3, fold=fold)
    alone = trees.fit_forest(df.where(fold != 1), ["kind"], ["x"], "y", trees=1, depth=3, bootstrap=False, tried=2)
    held = cv.forest
    assert held.trees == 6 and alone.forest.n0[0] + alone.forest.n1[0] == 400
    assert all(abs(held.n0[t] + held.n1[t] - 400) < 100 for t in range(6))


def test_many_partitions_and_blocks(spark):
    df, _ = table(spark, 900)
    want = trees.fit_forest(df, ["kind"], ["x", "z"], "y", trees=3, depth=7, least=3)
    got = trees.fit_forest(df, ["kind"], ["x", "z"], "y", trees=3, depth=7, least=3, block=5, lot=2)
    assert all(np.array_equal(x, y) for x, y in zip(got.forest[1:], want.forest[1:]))


def test_odd_tables(spark):
    schema = "kind string, x double, y int"
    none = trees.fit_forest(spark.createDataFrame([], schema), ["kind"], ["x"], "y", trees=2, depth=3)
    rows = [(None, None, 1), ("a", float("nan"), 0), ("new", 3.0, None)]
    df = spark.createDataFrame(rows, schema)
    assert [r["p"] for r in none.transform(df).collect()] == [0.5] * 3
    assert none.transform(df.limit(0)).count() == 0 and sum(none.importance().values()) == 0
    one = trees.fit_forest(spark.createDataFrame([("a", 1.0, 1)] * 50, schema), ["kind"], ["x"], "y", trees=2, depth=3)
    assert [r["p"] for r in one.transform(df).collect()] == [1.0] * 3
    mixed = trees.fit_forest(spark.createDataFrame(rows * 40, schema), ["kind"], ["x"], "y", trees=3, depth=3)
    got = {r["y"]: r["p"] for r in mixed.transform(df).collect()}
    assert got[1] > 0.9 and got[0] < 0.1


@pytest.mark.parametrize("mean", [1, 3, 16, 40])
def test_draws_follow_poisson(mean):
    key = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = trees.redrawn(np.full(20_000, mean), key)
    assert abs(drawn.mean() - mean) < 0.05 * mean + 0.02 and abs(drawn.var() - mean) < 0.1 * mean
    assert (trees.redrawn(np.zeros(5, int), key[:5]) == 0).all()


def test_tuning_reports_every_setting(spark, make):
    rng = np.random.default_rng(1)
    rows = [{"lead_time": int(t), "is_canceled": int(rng.random() < t / 400), "adr": float(rng.integers(50, 200)),
             "deposit_type": rng.choice(["No Deposit", "Refundable"])} for t in rng.integers(0, 400, 400)]
    train = models.booking_features(make([{**r, "lead_time": int(r["lead_time"]), "deposit_type": str(r["deposit_type"])} for r in rows]))
    model, scores = models.tune_cv(train, trees=[2, 4], depths=[1, 3], folds=2)
    got = {(r["trees"], r["depth"]): r["roc_auc"] for r in scores.collect()}
    assert set(got) == {(2, 1), (2, 3), (4, 1), (4, 3)} and all(0.55 < v < 1 for v in got.values())
    best = max(got, key=got.get)
    assert (model.forest.trees, model.settings.depth) == best
    parts = models.feature_importance(model, spark).collect()
    assert abs(sum(r["importance"] for r in parts) - 1) < 1e-9 and parts[0]["variable"].startswith("lead_time")
