"""Logits of many groups and exact resampled medians against brute force."""

import math

import numpy as np
import pytest

from lodgemetrics.functions import medians
from lodgemetrics.operators import stats as T


def newton(x, y, steps=60):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        info = (x * (p * (1 - p))[:, None]).T @ x
        beta = beta + np.linalg.solve(info, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    return beta, np.sqrt(np.diag(np.linalg.inv(info))), -2 * np.where(y == 1, np.log(p), np.log(1 - p)).sum()


def rows_of(n=600):
    rng = np.random.default_rng(8)
    out = []
    for i in range(n):
        group, lead, kind = ["a", "b", None][i % 3], int(rng.integers(0, 300)), str(rng.choice(["x", "y", "z"]))
        eta = -1 + 0.01 * lead + {"x": 0, "y": 0.8, "z": -0.5}[kind] + (0.5 if group == "b" else 0)
        out.append((group, lead, kind, int(rng.random() < 1 / (1 + math.exp(-eta)))))
    return out


def test_logits_of_all_groups_at_once(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "g string, lead int, kind string, t int")
    got = {(r["g"], r["term"]): r for r in T.odds_ratio_logit(df, ["lead"], {"kind": ["x", "y", "z"]}, "t", ["g"]).collect()}
    assert len(got) == 12
    for g in ("a", "b", None):
        own = [r for r in rows if r[0] == g]
        x = np.array([[1, r[1], r[2] == "y", r[2] == "z"] for r in own], float)
        y = np.array([r[3] for r in own], float)
        beta, error, deviance = newton(x, y)
        null = -2 * (y.sum() * math.log(y.mean()) + (1 - y).sum() * math.log(1 - y.mean()))
        for i, term in enumerate(["(intercept)", "lead", "kind=y", "kind=z"]):
            r = got[g, term]
            assert math.isclose(r["coef"], beta[i], rel_tol=1e-6) and math.isclose(r["std_err"], error[i], rel_tol=1e-6)
            assert math.isclose(r["lr_chi2"], null - deviance, rel_tol=1e-6) and r["lr_df"] == 3


def test_terms_a_group_does_not_tell(spark):
    rows = [("a", "x", i % 2) for i in range(20)] + [("b", k, t) for k in "xy" for t in (0, 1, 1)]
    df = spark.createDataFrame([(*r, 1.0, 2.0) for r in rows], "g string, kind string, t int, one double, two double")
    got = {(r["g"], r["term"]): r for r in T.odds_ratio_logit(df, ["one"], {"kind": ["x", "y"]}, "t", ["g"]).collect()}
    assert got["a", "kind=y"]["coef"] is None and got["a", "one"]["coef"] is None and got["a", "one"]["lr_df"] == 0
    assert abs(got["a", "(intercept)"]["coef"]) < 1e-9 and got["b", "kind=y"]["lr_df"] == 1
    none = T.odds_ratio_logit(df.limit(0), ["one"], {"kind": ["x", "y"]}, "t", ["g"])
    assert none.count() == 0


def test_separated_groups_end(spark):
    df = spark.createDataFrame([("a", float(i), int(i > 5)) for i in range(12)] + [("b", 1.0, 1)], "g string, x double, t int")
    got = {(r["g"], r["term"]): r for r in T.odds_ratio_logit(df, ["x"], {}, "t", ["g"]).collect()}
    assert got["a", "x"]["coef"] > 5 and got["a", "x"]["pseudo_r2"] > 0.99 and got["b", "x"]["coef"] is None


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_median_chances_are_those_of_all_resamples(n):
    from itertools import product

    values = [1.0, 2.0, 2.0, 4.0, 9.0][:n]
    want = {}
    for draw in product(values, repeat=n):
        m = float(np.median(draw))
        want[m] = want.get(m, 0) + n ** -n
    kept, at, count = np.unique(values, return_inverse=True, return_counts=True)
    upto = np.cumsum(count)
    got = {v: p for v, p in zip(*medians.resampled_median(kept, upto - count, upto, n)) if p > 1e-12}
    assert set(got) == set(want) and all(math.isclose(got[v], want[v], rel_tol=1e-9) for v in want)


def test_binomial_upper():
    for n, k in ((10, 4), (200, 100), (200, 1), (7, 0), (30, 30)):
        p = np.array([0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0])
        want = [sum(math.comb(n, j) * q ** j * (1 - q) ** (n - j) for j in range(k, n + 1)) for q in p]
        assert np.allclose(medians.binomial_upper(n, k, p), want, rtol=1e-10, atol=1e-14)


def test_interval_agrees_with_ten_thousand_resamples(spark):
    rng = np.random.default_rng(4)
    a, b = rng.exponential(50, 301).round(1), rng.exponential(80, 400).round(1)
    rows = [(float(v), 0, "k") for v in a] + [(float(v), 1, "k") for v in b] + [(3.0, 0, "lonely"), (None, 1, "k")]
    df = spark.createDataFrame(rows, "x double, g int, by string").repartition(4)
    got = {r["by"]: r for r in T.bootstrap_median_diff(df, "x", "g", by=["by"]).collect()}
    draws = [np.median(rng.choice(b, 400)) - np.median(rng.choice(a, 301)) for _ in range(10_000)]
    mean, low, high = np.quantile(draws, [0.5, 0.025, 0.975])
    r = got["k"]
    assert abs(r["median_diff"] - mean) < 1.0 and abs(r["ci_low"] - low) < 1.5 and abs(r["ci_high"] - high) < 1.5
    assert (r["n0"], r["n1"]) == (301, 400) and got["lonely"]["ci_low"] is None
    assert T.bootstrap_median_diff(df.limit(0), "x", "g").count() == 0


def test_many_values_merge_into_cells():
    rng = np.random.default_rng(2)
    v = np.sort(rng.normal(size=40_000))
    at = slice(18_000, 22_000)
    one = medians.resampled_median(v[at], np.arange(40_000)[at], np.arange(1, 40_001)[at], 40_000)
    assert abs(one[1].sum() - 1) < 1e-9
    low, high = medians.difference_quantiles(one, one, [0.025, 0.975])
    sd = math.sqrt(math.pi / 2) / 200 * math.sqrt(2)  # asymptotic error of a median's difference
    assert abs(high - 1.96 * sd) < 0.1 * sd and abs(low + 1.96 * sd) < 0.1 * sd
