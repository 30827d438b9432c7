"""Queries over narrow rows written once: the result no longer reads the tables, however often it looks at them."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", ["tests_by_hotel", "star_join", "fk_check", "rolling_median_by_lead", "rate_model", "bootstrap_delta_auc"])
def test_tables_are_joined_once(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan

def test_poisson_weights_are_those_of_the_whole_number():
    from lodgemetrics.operators import policy

    cell = np.random.default_rng(2).integers(-2 ** 62, 2 ** 62, 3000)
    n = np.where(np.arange(3000) % 3 == 0, 2, 1)
    x = cell.view(np.uint64)[:, None] + np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0 ** -53
    want = np.empty(u.shape)
    for mean in (1, 2):
        steps = policy._poisson_table(mean)[0]
        want[n == mean] = np.searchsorted(steps, u[n == mean], "right")
    assert np.array_equal(policy._poisson_weights(cell, n, 40), want)


def test_drawn_rows_are_those_of_the_whole_number():
    from lodgemetrics.operators import trees

    key = np.random.default_rng(3).integers(0, 2 ** 63, 50_000).astype(np.uint64)
    counts = np.random.default_rng(4).integers(0, 60, 50_000)
    want = [np.searchsorted(trees._STEPS[m], u, "right") if m else 0 for m, u in zip(counts.tolist(), trees._uniform(key))]
    assert np.array_equal(trees.redrawn(counts, key), want)


def test_counts_travel_in_narrow_numbers():
    from lodgemetrics.operators import trees

    n0, n1 = np.arange(640.0) % 200, np.zeros(640)
    packed = trees._packed(n0, n1)
    assert sum(map(len, packed)) <= 2 * 640
    sparse = trees._packed(np.where(n0 == 7, 70_000.0, 0), n1)
    assert sum(map(len, sparse)) < 100
