"""Smoothing over missing months, intervals that widen, and dimensions numbered by ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgemetrics.operators import forecast as O
from lodgemetrics.operators import prepare, star


def series(spark, values, t0=24000, absent=()):
    rows = [("City Hotel", "adr", t0 + i, None if v is None else float(v)) for i, v in enumerate(values) if i not in absent]
    return spark.createDataFrame(rows, "hotel string, metric string, t int, value double")


def points(spark, values, h=2, **more):
    fit = O.holt_fit(series(spark, values, **more))
    return [round(r["forecast"], 9) for r in O.holt_forecast(fit, h).orderBy("step").collect()]


def test_missing_months_do_not_bend_a_line(spark):
    want = [70.0, 80.0]
    assert points(spark, [10, 20, 30, 40, 50, 60]) == want
    assert points(spark, [10, 20, None, 40, 50, 60]) == want
    assert points(spark, [10, None, None, 40, 50, 60]) == want
    assert points(spark, [10, 20, 30, 40, 50, None]) == want
    assert points(spark, [None, 20, 30, None, 50, 60]) == want
    assert points(spark, [10, 20, 30, 40, 50, 60], absent=(2, 3)) == want
    first = O.holt_forecast(O.holt_fit(series(spark, [10, 20, 30, 40, None, None])), 1).first()
    assert first["t"] == 24006 and O.holt_fit(series(spark, [None, 10, None])).count() == 0


def holt_paths(alpha, beta, steps, n, rng):
    """Errors of h-step forecasts of the smoothing model itself."""
    out = []
    for _ in range(n):
        level, trend = 100.0, 1.0
        y = []
        l, b = level, trend
        for _ in range(steps):
            e = rng.normal()
            y.append(l + b + e)
            l, b = l + b + alpha * e, b + alpha * beta * e
        out.append([v - (level + (i + 1) * trend) for i, v in enumerate(y)])
    return np.array(out)


def test_intervals_cover_what_they_say(spark):
    rng = np.random.default_rng(6)
    alpha, beta, h = 0.5, 0.3, 8
    fit = spark.createDataFrame([("City Hotel", "adr", alpha, beta, 101, 24000, 100.0, 1.0, 100.0)],
                                "hotel string, metric string, alpha double, beta double, n long, last_t int, level double, trend double, sse double")
    half = [(r["upper"] - r["lower"]) / 2 for r in O.holt_forecast(fit, h).orderBy("step").collect()]
    assert np.isclose(half[0], 1.96) and all(a < b for a, b in zip(half, half[1:]))
    inside = (np.abs(holt_paths(alpha, beta, h, 4000, rng)) <= np.array(half)).mean(axis=0)
    assert (np.abs(inside - 0.95) < 0.015).all()


def test_seasonal_intervals_step_up_at_whole_seasons(spark):
    rng = np.random.default_rng(3)
    values = [100 + i + 10 * np.sin(i * np.pi / 6) + rng.normal() for i in range(60)]
    fit = O.holt_winters_fit(series(spark, values))
    half = [(r["upper"] - r["lower"]) / 2 for r in O.holt_winters_forecast(fit, 14).orderBy("step").collect()]
    assert all(a <= b for a, b in zip(half, half[1:])) and half[-1] > half[0]


@pytest.mark.parametrize("nulls", [False, True])
def test_members_are_numbered_in_order(spark, nulls):
    rows = [(a, b) for a in ["x", "y", None, "z"] for b in [3, 1, None, 2]] * 3
    df = spark.createDataFrame(rows, "a string, b int").repartition(7)
    got = [(r["k"], r["a"], r["b"]) for r in star.build_dim(df, ["a", "b"], "k", nulls).orderBy("k").collect()]
    kept = {r for r in rows if nulls or None not in r}
    order = sorted(kept, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0))
    assert got == [(i + 1, *r) for i, r in enumerate(order)]
    assert star.build_dim(df.limit(0), ["a"], "k").count() == 0


def test_a_million_members_without_one_ordered_task(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.range(1_000_000).select(F.concat(F.lit("m"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("name"))
        dim = star.build_dim(df, ["name"], "k")
        plan = dim._jdf.queryExecution().toString()
        wrong = dim.where(F.concat(F.lit("m"), F.lpad((F.col("k") - 1).cast("string"), 7, "0")) != F.col("name"))
        assert "SinglePartition" not in plan and wrong.count() == 0
        assert dim.agg(F.max("k")).first()[0] == 1_000_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_quartiles_of_a_table(spark):
    df = spark.createDataFrame([(float(v), None) for v in [0, 1, 2, 10]] + [(None, None)], "a double, b double")
    got = {r["column_name"]: r for r in prepare.describe_table(df, ["a", "b"]).collect()}
    assert (got["a"]["q25"], got["a"]["median"], got["a"]["q75"]) == (0.75, 1.5, 4.0)
    assert got["b"]["n"] == 0 and got["b"]["median"] is None
