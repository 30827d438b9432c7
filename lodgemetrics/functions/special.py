"""Tail probabilities for test statistics, vectorised over small aggregated columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(v) if not math.isnan(v) else np.nan for v in x])


def _series(values: pd.Series) -> np.ndarray:
    return values.to_numpy(dtype=float, na_value=np.nan)


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: power series below a + 1, continued fraction above."""
    if math.isnan(a) or math.isnan(x) or a <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + even * d)
        c = 1 + even / c
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + odd * d)
        c = 1 + odd / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def normal_two_sided(z):
    """P(|Z| >= |z|)."""
    @F.pandas_udf(DoubleType())
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(_erfc(np.abs(_series(v)) / math.sqrt(2)))
    return run(z)


def chi2_sf(x, dof):
    """P(chi-square with dof >= x)."""
    @F.pandas_udf(DoubleType())
    def run(v: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([_gamma_upper(d / 2, s / 2) for s, d in zip(_series(v), _series(k))])
    return run(x, dof)


def t_two_sided(t, dof):
    """P(|T| >= |t|) for Student's t."""
    @F.pandas_udf(DoubleType())
    def run(v: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([
            math.nan if math.isnan(s) or math.isnan(d) or d <= 0
            else _beta_inc(d / 2, 0.5, d / (d + s * s)) for s, d in zip(_series(v), _series(k))])
    return run(t, dof)


def fisher_two_sided(a, b, c, d):
    """Exact two-sided p of a 2 x 2 table: hypergeometric terms no likelier than the observed one.

    Both tails are summed outwards, from the observed cell and from the first cell on the other side that is no
    likelier, until terms no longer change the sum. NULL for an empty table.
    """
    def one(a: float, b: float, c: float, d: float) -> float | None:
        row, col, n = a + b, a + c, a + b + c + d
        if not n > 0:
            return None
        low, high = max(0.0, row + col - n), min(row, col)
        lg = math.lgamma
        whole = lg(row + 1) + lg(n - row + 1) + lg(col + 1) + lg(n - col + 1) - lg(n + 1)

        def log_p(k: float) -> float:
            return whole - lg(k + 1) - lg(row - k + 1) - lg(col - k + 1) - lg(n - row - col + k + 1)

        def tail(k: float, step: int) -> float:
            """Sum of terms from k on, away from the mode: each follows from the one before."""
            term = total = math.exp(log_p(k)) if low <= k <= high else 0.0
            while term > 1e-17 * total:
                if step > 0:
                    term *= (row - k) * (col - k) / ((k + 1) * (n - row - col + k + 1))
                else:
                    term *= k * (n - row - col + k) / ((row - k + 1) * (col - k + 1))
                k += step
                total += term
            return total

        mode = min(high, max(low, math.floor((row + 1) * (col + 1) / (n + 2))))
        limit = log_p(a) + 1e-7
        if log_p(mode) <= limit:
            return 1.0
        side = -1 if a < mode else 1  # the observed cell's tail; the other starts at its mirror
        inner, outer = mode, (high + 1 if side < 0 else low - 1)
        while abs(outer - inner) > 1:
            k = math.floor((inner + outer) / 2)
            inner, outer = (inner, k) if log_p(k) <= limit else (k, outer)
        return min(1.0, tail(a, side) + tail(outer, -side))

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([one(*map(float, r)) for r in zip(a, b, c, d)])
    return run(a, b, c, d)


def mcnemar_exact(n01, n10):
    """Exact two-sided binomial p of discordant counts."""
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(_series(a), _series(b)):
            low, n = min(x, y), x + y
            out.append(min(1.0, 2 * _beta_inc(n - low, low + 1, 0.5)) if n > 0 else 1.0)
        return pd.Series(out)
    return run(n01, n10)


def poisson_draw(lam, u, v):
    """Poisson counts with mean lam from two uniform columns: same inputs, same draw.

    Small means invert the distribution function; large means use the normal limit.
    """
    @F.pandas_udf("long")
    def run(lam: pd.Series, u: pd.Series, v: pd.Series) -> pd.Series:
        m, a, b = _series(lam), _series(u), _series(v)
        big = m > 50
        z = np.sqrt(-2 * np.log(np.maximum(a, 1e-300))) * np.cos(2 * np.pi * b)
        out = np.where(big, np.maximum(np.rint(m + np.sqrt(m) * z), 0), 0)
        p = np.exp(-np.where(big, 0, m))
        cdf, k = p.copy(), 0
        todo = ~big & (a > cdf)
        while todo.any() and k < 400:
            k += 1
            p = p * m / k
            cdf = cdf + p
            out[todo] = k
            todo = todo & (a > cdf)
        return pd.Series(out.astype("int64"))
    return run(lam, u, v)
