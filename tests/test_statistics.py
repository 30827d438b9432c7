import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgemetrics.functions import special
from lodgemetrics.operators import policy as P
from lodgemetrics.operators import stats as T


def one(spark, make_column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} double" for i in range(len(values))))
    return df.select(make_column(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


# chi-square tail with even dof 2m in closed form: exp(-x/2) * sum of (x/2)^i / i! for i < m
EVEN_DOF = sum(math.exp(-500 + i * math.log(500) - math.lgamma(i + 1)) for i in range(450))


@pytest.mark.parametrize("fn, args, expected", [
    (special.normal_two_sided, (1.959963985,), 0.05), (special.chi2_sf, (3.841458821, 1.0), 0.05),
    (special.chi2_sf, (18.30703805, 10.0), 0.05), (special.chi2_sf, (1000.0, 900.0), EVEN_DOF),
    (special.t_two_sided, (2.262157163, 9.0), 0.05), (special.t_two_sided, (12.7062047, 1.0), 0.05),
    (special.fisher_two_sided, (8.0, 2.0, 1.0, 5.0), 0.034965035), (special.mcnemar_exact, (995.0, 587.0), 7.81766e-25),
])
def test_tail_probabilities(spark, fn, args, expected):
    assert math.isclose(one(spark, fn, *args), expected, rel_tol=1e-5)


@pytest.fixture(scope="module")
def two(spark):
    rng = np.random.default_rng(3)
    x0, x1 = rng.integers(0, 60, 400), rng.integers(5, 70, 300)
    rows = [(int(v), 0, "a" if v % 3 else "b") for v in x0] + [(int(v), 1, "a" if v % 2 else "b") for v in x1]
    return rows, spark.createDataFrame(rows, "x int, g int, c string")


def test_mann_whitney_brute_force(two):
    rows, df = two
    a, b = [r[0] for r in rows if r[1] == 0], [r[0] for r in rows if r[1] == 1]
    u = sum((p > q) + 0.5 * (p == q) for p in a for q in b)
    r = T.mann_whitney(df, "x", "g").first()
    assert r.u_stat == u and math.isclose(r.rank_biserial, 1 - 2 * u / (len(a) * len(b)))
    assert 0 < r.p_value < 1e-3


def test_yates_correction_and_full_grid(spark):
    rows = [("a", 0)] * 10 + [("a", 1)] * 20 + [("b", 0)] * 30
    r = T.association(T.contingency(spark.createDataFrame(rows, "v string, y int"), ["v"], "y")).first()
    o, e = np.array([[10, 20], [30, 0]]), np.array([[20, 10], [20, 10]])
    assert math.isclose(r.chi2, ((abs(o - e) - 0.5) ** 2 / e).sum()) and r.min_expected == 10


def test_single_category_has_no_cramers_v(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1)], "v string, y int")
    assert T.cramers_v(df, "v", "y").first().cramers_v is None


def test_partial_corr_equals_residual_corr(spark):
    rng = np.random.default_rng(5)
    z, w = rng.normal(size=200), rng.normal(size=200)
    x, y = z + 0.5 * w + rng.normal(size=200), 2 * z - w + rng.normal(size=200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z, w)], "x double, y double, z double, w double")
    m = np.column_stack([np.ones(200), z, w])
    res = [v - m @ np.linalg.lstsq(m, v, rcond=None)[0] for v in (x, y)]
    assert math.isclose(T.partial_corr(df, "x", "y", ["z", "w"]).first().partial_corr, np.corrcoef(*res)[0, 1], rel_tol=1e-9)


def test_bootstrap_is_repeatable_and_sensible(two):
    rows, df = two
    runs = [T.bootstrap_median_diff(d, "x", "g", 60).first() for d in (df, df.repartition(5))]
    assert runs[0] == runs[1] and runs[0].replicates == 60
    true = np.median([r[0] for r in rows if r[1]]) - np.median([r[0] for r in rows if not r[1]])
    assert runs[0].ci_low <= true <= runs[0].ci_high


def test_logit_recovers_a_2x2_odds_ratio(spark):
    rows = [(0.0, "n", 0)] * 40 + [(0.0, "n", 1)] * 10 + [(0.0, "y", 0)] * 20 + [(0.0, "y", 1)] * 30
    rows = [(float(i % 7), c, t) for i, (_, c, t) in enumerate(rows)]
    out = T.odds_ratio_logit(spark.createDataFrame(rows, "x double, c string, t int"), [], {"c": ["n", "y"]}, "t")
    got = {r.term: r.odds_ratio for r in out.collect()}
    assert math.isclose(got["c=y"], (40 * 30) / (10 * 20), rel_tol=1e-4)


def test_auc_brute_force_with_ties(spark):
    rng = np.random.default_rng(11)
    rows = [(float(np.round(p, 2)), int(rng.random() < p)) for p in rng.random(400)]
    df = spark.createDataFrame(rows, "p double, is_canceled int")
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(P.roc_auc(df).first().roc_auc, auc, rel_tol=1e-12)


def test_sweep_agrees_with_confusion_at_each_threshold(spark):
    rng = np.random.default_rng(2)
    rows = [(round(float(p), 2), int(rng.random() < p), "Online TA" if i % 2 else "Direct") for i, p in enumerate(rng.random(300))]
    df = spark.createDataFrame(rows, "p double, is_canceled int, market_segment string").withColumn("p2", F.col("p"))
    sweep = {r.t1: (r.tn, r.fp, r.fn, r.tp) for r in P.threshold_sweep(df).collect()}
    for t in (0.28, 0.35, 0.55):
        r = P.confusion_at(df, t).first()
        assert sweep[t] == (r.tn, r.fp, r.fn, r.tp)
    best = P.pick_policy(P.threshold_sweep(df, "dual_and")).first()
    assert best.recall >= 0.85


def test_walk_order_and_buffer_caps(make):
    df = make([{"adr": 90.0}, {"adr": 50.0, "is_repeated_guest": 1}, {"adr": 50.0, "lead_time": 2}, {"adr": 50.0, "lead_time": 9}])
    assert [r.booking_key for r in P.walk_order(df).orderBy("walk_rank").collect()] == [3, 4, 2, 1]
    b = make([{"market_segment": s, "is_canceled": c} for s in ("Groups", "Direct") for c in (1, 1, 0)]
             + [{"market_segment": "Corporate", "is_canceled": int(i == 0)} for i in range(10)])
    got = {r.market_segment: round(r.buffer, 6) for r in P.overbooking_buffer(b).collect()}
    assert got == {"Groups": 0.15, "Direct": 0.2, "Corporate": 0.06}


def test_one_sided_groups_give_nulls_not_errors(spark):
    df = spark.createDataFrame([(1, 0, "h"), (2, 0, "h"), (5, 1, "k")], "x int, g int, hotel string")
    assert all(r.rank_biserial is None and r.z_stat is None for r in T.mann_whitney(df, "x", "g", ["hotel"]).collect())
    assert all(r.t_stat is None for r in T.welch_t(df, "x", "g", ["hotel"]).collect())
