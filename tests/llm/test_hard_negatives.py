"""Hard negatives against brute force; table scores against plain products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgemetrics.llm import hard_negatives as H


@pytest.mark.parametrize("dim,size", [(1, 3), (8, 200), (13, 5), (64, 140), (20, 10 ** 6)])
def test_scores_are_products(dim, size):
    rng = np.random.default_rng(dim)
    v, a = rng.integers(-size, size, (50, dim)), rng.integers(-size, size, (7, dim))
    bits = max(int(v.max()).bit_length(), int(-v.min() - 1).bit_length()) + 1
    assert (H.scores(H.bit_planes(v, bits), H.subset_sums(a, np.int64)) == v @ a.T).all()


def test_best_keeps_ties_by_id():
    best = H.Best(2, 2)
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(40):
        score, ids = rng.integers(0, 5, (30, 2)), rng.integers(0, 10 ** 6, 30)
        best.add(np.array([0, 1]), score, ids, score < 4)
        rows += [(s, -int(score[i, s]), int(ids[i])) for i in range(30) for s in (0, 1) if score[i, s] < 4]
    want = [x for s in (0, 1) for x in sorted(r for r in rows if r[0] == s)[:2]]
    assert [(int(s), -int(x), int(i)) for s, x, i in zip(*best.reduced())] == want


def brute(rows, anchors, positives=5, negatives=3, least=50, most=95):
    v = [(i, lab, [math.floor(256 * c) for c in x]) for i, lab, x in rows
         if i is not None and lab is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for a, lab, x in (r for r in v if anchors(r[0])):
        scored = [(-sum(p * q for p, q in zip(x, y)), i, la) for i, la, y in v if i != a and len(y) == len(x)]
        for s, p, _ in sorted(r for r in scored if r[2] == lab)[:positives]:
            fit = sorted(r for r in scored if r[2] != lab and least * -s <= 100 * -r[0] <= most * -s)[:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fit)]
    return sorted(out)


def answer(spark, rows, **more):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, label int, embedding array<float>, slot int")
    v = H.quantized(df.repartition(3), F.col("label"))
    found = H.mine(v, v.filter(F.col("vec_id") % 5 == 0), **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def sample(seed, n, dim=10):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        lab = rng.choice([0, 0, 1, 2, 3])
        x = [round(rng.gauss(c, 1) * 4) / 16 for c in centre[lab]]
        rows.append((i, lab, x))
    return rows


def test_against_brute_force(spark):
    rows = sample(1, 300)
    got = answer(spark, rows)
    assert got == brute(rows, lambda i: i % 5 == 0) and len(got) > 100


def test_chunks_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 7)
    monkeypatch.setattr(H, "TABLES", 3)
    monkeypatch.setattr(H, "ROWS", 11)
    rows = sample(2, 150)
    assert answer(spark, rows, positives=2, negatives=4, least=10, most=100) == brute(
        rows, lambda i: i % 5 == 0, 2, 4, 10, 100)


def test_ties_nulls_and_dimensions(spark):
    one = [0.5, 0.25, 0.0]
    rows = [(i, i % 2, one) for i in range(12)] + [(100 + i, 1, [0.45, 0.225, 0.0]) for i in range(6)]
    rows += [(30, None, one), (31, 0, None), (32, 0, [0.1, None, 0.2]), (33, 0, [0.1, float("nan"), 0.2]), (None, 0, one),
             (35, 0, [float("inf"), 0.0, 0.0]), (40, 0, [0.5, 0.5]), (41, 0, [0.5, 0.4]), (42, 1, [0.4, 0.45]), (45, 1, []),
             (50, 7, [0.1, 0.1, 0.1]), (55, 0, [-1.0, -1.0, -1.0]), (60, 0, [0.0, 0.0, 0.0])]
    got = answer(spark, rows)
    assert got == brute(rows, lambda i: i % 5 == 0) and any(r[0] == 40 for r in got)
    assert answer(spark, []) == []
    assert answer(spark, [(1, 0, one)]) == []


def test_repeated_ids(spark):
    rows = [(5, 0, [1.0, 0.0]), (5, 0, [1.0, 0.0]), (6, 0, [0.9, 0.1]), (7, 1, [0.7, 0.0]), (7, 1, [0.7, 0.0])]
    got = answer(spark, rows)
    assert got == brute(rows, lambda i: i % 5 == 0)


def test_scores_beyond_64_bits_are_refused(spark):
    df = spark.createDataFrame([(5, 0, [1e13]), (6, 0, [1e13])], "vec_id long, label int, embedding array<double>")
    v = H.quantized(df, F.col("label"))
    with pytest.raises(ValueError):
        H.mine(v, v)
