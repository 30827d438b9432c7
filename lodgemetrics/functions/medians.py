"""The median of a resample, exactly: its distribution from ranks and binomial probabilities."""

from __future__ import annotations

import math

import numpy as np

#: Values of a median told apart in a difference; more are merged into cells of equal probability.
CELLS = 2000


def binomial_upper(n: int, k: int, p: np.ndarray) -> np.ndarray:
    """P(Binomial(n, p) >= k), summed from k away from the mean, so terms only fall."""
    out = np.zeros(len(p))
    out[p >= 1] = 1.0
    if k <= 0:
        return np.ones(len(p))
    for rising in (True, False):  # p below k / n: k, k + 1, ...; else one less k - 1, k - 2, ...
        at = np.flatnonzero((p > 0) & (p < 1) & ((p < k / n) == rising))
        if not len(at) or (rising and k > n):
            continue
        q = p[at]
        j = k if rising else k - 1
        term = np.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * np.log(q) + (n - j) * np.log1p(-q))
        total = term.copy()
        while 0 < j < n or (rising and j < n):
            term = term * ((n - j) / (j + 1) * q / (1 - q) if rising else j / (n - j + 1) * (1 - q) / q)
            j += 1 if rising else -1
            total += term
            if not (term > 1e-18 * total).any():
                break
        out[at] = total if rising else 1 - total
    return out


def resampled_median(value: np.ndarray, below: np.ndarray, upto: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, chances) of the median of n draws with replacement from n rows.

    ``value`` are rising distinct values with the number of rows ``below`` each and ``upto`` it; values at either end may
    be left out. For even n the median is the mean of the two middle draws a <= b.
    """
    low, high = below / n, upto / n
    if n % 2:
        k = (n + 1) // 2
        return value, np.maximum(binomial_upper(n, k, high) - binomial_upper(n, k, low), 0.0)
    k = n // 2
    choose = math.lgamma(n + 1) - 2 * math.lgamma(k + 1)

    def power_gap(large: np.ndarray, small: np.ndarray) -> np.ndarray:
        """log(large**k - small**k)."""
        with np.errstate(divide="ignore"):
            fall = np.where(small > 0, k * (np.log(np.maximum(small, 1e-300)) - np.log(large)), -np.inf)
            return k * np.log(large) + np.log(-np.expm1(fall))

    first = power_gap(high, low)  # the k-th draw is this value, and the others above it
    second = power_gap(1 - low, 1 - high)
    with np.errstate(divide="ignore"):
        above = np.exp(choose + first + np.where(high < 1, k * np.log(np.maximum(1 - high, 1e-300)), -np.inf))
    same = binomial_upper(n, k, high) - binomial_upper(n, k, low) - above
    values, chances = [value], [np.maximum(same, 0.0)]
    left, gap = above.sum(), 1
    while gap < len(value) and left > 1e-14:  # both middle draws at values ``gap`` places apart
        chance = np.exp(choose + first[:-gap] + second[gap:])
        values.append((value[:-gap] + value[gap:]) / 2)
        chances.append(chance)
        left -= chance.sum()
        gap += 1
    return _merged(np.concatenate(values), np.concatenate(chances))


def _merged(value: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept, at = np.unique(value, return_inverse=True)
    return kept, np.bincount(at, chance, len(kept))


def _cells(value: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most about CELLS values: neighbours merge into cells of equal probability, told by their mean."""
    if len(value) <= CELLS:
        return value, chance
    cell = np.minimum((np.cumsum(chance) / chance.sum() * CELLS).astype(int), CELLS - 1)
    total = np.bincount(cell, chance, CELLS)
    used = total > 0
    return (np.bincount(cell, chance * value, CELLS)[used] / total[used]), total[used]


def difference_quantiles(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], probs: list[float]
                         ) -> list[float]:
    """Quantiles of the difference of two independent discrete variables (values, chances)."""
    (v, p), (w, q) = _cells(*one), _cells(*other)
    value, chance = _merged((v[:, None] - w[None, :]).ravel(), (p[:, None] * q[None, :]).ravel())
    upto = np.cumsum(chance) / chance.sum()
    return [float(value[min(np.searchsorted(upto, x - 1e-12), len(value) - 1)]) for x in probs]
