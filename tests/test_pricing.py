import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgemetrics.operators import forecast as O
from lodgemetrics.operators import models as M
from lodgemetrics.operators import pricing as P


def panel(spark, rows):
    """rows: hotel, year_month, adr, demand, occ, cancel rate."""
    df = spark.createDataFrame(rows, "hotel string, year_month string, adr double, demand double, occ double, cancel_rate double")
    month = F.substring("year_month", 6, 2).cast("int")
    return df.withColumn("month_number", month).withColumns({
        "season": P.bands.season("month_number"), "log_demand": F.log("demand"), "log_adr": F.log("adr")})


@pytest.fixture(scope="module")
def history(spark):
    rng = np.random.default_rng(9)
    rows = []
    for h in ("City Hotel", "Resort Hotel"):
        for y in (2015, 2016, 2017):
            for m in range(1, 13):
                adr = 80 + 5 * m + rng.normal(0, 6)
                eps = -1.3 if h == "City Hotel" else 0.8
                rows.append((h, f"{y}-{m:02d}", float(adr), float(5000 * (adr / 100) ** eps * (1 + 0.2 * (m == 7)) * math.exp(rng.normal(0, .02))),
                             0.7, 0.2 + 0.001 * m))
    return rows, panel(spark, rows)


def test_month_effects_equal_dummy_regression(history):
    rows, df = history
    got = {r.hotel: r for r in P.elasticity_loglog_fe(df).collect()}
    for h in got:
        sub = [r for r in rows if r[0] == h]
        months = np.array([int(r[1][5:]) for r in sub])
        x, y = np.log([r[2] for r in sub]), np.log([r[3] for r in sub])
        m = np.column_stack([np.ones(len(sub)), x, *[(months == k).astype(float) for k in range(2, 13)]])
        beta = np.linalg.lstsq(m, y, rcond=None)[0]
        res = y - m @ beta
        se = math.sqrt(res @ res / (len(y) - m.shape[1]) * np.linalg.inv(m.T @ m)[1, 1])
        assert math.isclose(got[h].elasticity, beta[1], rel_tol=1e-8) and math.isclose(got[h].std_err, se, rel_tol=1e-6)


def test_positive_slope_falls_back_to_the_prior(history):
    _, df = history
    est = P.elasticity_loglog_fe(df).unionByName(P.elasticity_first_diff(df))
    got = {r.hotel: r for r in P.pick_elasticity(est).collect()}
    assert (got["Resort Hotel"].elasticity_primary, got["Resort Hotel"].source_method) == (-1.10, "rm_prior")
    assert got["City Hotel"].source_method == "loglog_ols_month_fe" and -2.5 <= got["City Hotel"].elasticity_primary < -1


def test_grid_matches_numpy_and_flat_curve_takes_lowest_price(spark):
    df = panel(spark, [("City Hotel", "2016-07", 100.0, 50.0, 0.7, 0.2), ("Resort Hotel", "2016-07", 90.0, 40.0, 0.6, 0.2)])
    for r in P.price_grid_optimize(df).collect():
        eps = {"City Hotel": -0.7, "Resort Hotel": -1.1}[r.hotel]
        prices = np.linspace(r.adr * .7, r.adr * 1.3, 161)
        q = np.minimum(np.clip(r.demand * (1 + eps * (prices - r.adr) / r.adr), .05 * r.demand, None), 1.15 * r.demand)
        i = int(np.argmax(prices * q))
        assert math.isclose(r.p_star, prices[i]) and math.isclose(r.rev_star, (prices * q)[i])
    flat = P.price_grid_optimize(df.withColumn("demand", F.lit(0.0)))
    assert all(math.isclose(r.p_star, r.adr * 0.7) for r in flat.collect())


def monthly(spark, rows):
    return spark.createDataFrame(rows, "hotel string, year_month string, adr double, occupancy_rate double, total_bookings long,"
                                       " successful_bookings long, canceled_bookings long, total_revenue double")


def test_scenario_clamps_per_row_and_zero_levers_change_nothing(spark):
    m = monthly(spark, [("City Hotel", "2016-01", 100.0, 0.04, 100, 4, 96, 800.0), ("City Hotel", "2016-02", 100.0, 1.0, 50, 50, 0, 9000.0)])
    sim = P.scenario_simulate(m, 0, 0, 0)
    assert [round(r.occ_sim, 4) for r in sim.orderBy("year_month").collect()] == [0.05, 0.99]
    safe = monthly(spark, [("City Hotel", "2016-01", 100.0, 0.6, 100, 60, 40, 800.0)])
    t = P.scenario_total(P.scenario_simulate(safe, 0, 0, 0)).first()
    assert t.revpar_baseline == t.revpar_scenario and t.delta_revenue_pct == 0.0
    zero = monthly(spark, [("City Hotel", "2016-01", 0.0, 0.0, 5, 0, 5, 0.0)])
    assert P.scenario_simulate(zero).first().revenue_sim == 0.0


def test_sensitivity_variants(spark):
    m = monthly(spark, [("City Hotel", "2016-01", 100.0, 0.995, 10, 9, 1, 900.0)])
    fixed = {r.scenario: r.revpar for r in P.sensitivity_4(m).collect()}
    live = {r.scenario: r.revpar for r in P.sensitivity_4(m, live=True).collect()}
    assert math.isclose(fixed["Baseline"], 99.0) and math.isclose(live["Baseline"], 99.5)


def test_short_history_uses_fallback_slope(spark):
    df = panel(spark, [("City Hotel", f"2016-0{i}", 100.0 + i, 50.0, 0.7, 0.2) for i in range(1, 5)])
    assert P.risk_slope(df).first().risk_slope == P.with_risk_slope(df).first().risk_slope == 0.05


def test_gates(spark):
    rows = [("City Hotel", "2016-07", 100.0, 50.0, 0.7, 0.2), ("Resort Hotel", "2016-01", 90.0, 40.0, 0.6, 0.2)]
    df = panel(spark, rows)
    bt = P.backtest_rules(P.with_risk_slope(df))
    got = {r.hotel: r for r in P.go_nogo_gates(bt).collect()}
    assert got["City Hotel"].win_rate == 1.0 and got["City Hotel"].go == 1
    assert got["Resort Hotel"].mean_delta_revpar_peak is None


def series(spark, values, start=2015 * 12 + 1):
    df = spark.createDataFrame([("h", "demand", start + i, v) for i, v in enumerate(values)],
                               "hotel string, metric string, t int, value double")
    return df.withColumns(O.calendar())


def test_seasonal_naive_recursion_and_mean_fallback(spark):
    got = [r.forecast for r in O.seasonal_naive(series(spark, [float(i) for i in range(1, 15)]), 14).orderBy("step").collect()]
    assert got == [float(i) for i in range(3, 15)] + [3.0, 4.0]
    short = O.seasonal_naive(series(spark, [1.0, 3.0]), 2).collect()
    assert [r.forecast for r in short] == [2.0, 2.0]


def test_holt_follows_a_line(spark):
    fit = O.holt_fit(series(spark, [10.0 + 2 * i for i in range(10)]))
    assert [round(r.forecast, 9) for r in O.holt_forecast(fit, 3).orderBy("step").collect()] == [30.0, 32.0, 34.0]


def test_decomposition_of_an_exact_season(spark):
    wave = [100.0 + i + 10 * ((i % 12) - 5.5) for i in range(36)]
    rows = O.seasonal_decompose(series(spark, wave)).where("trend IS NOT NULL").collect()
    assert len(rows) == 24 and all(abs(r.residual) < 1e-6 for r in rows)


def test_mape_skips_zero_actuals(spark):
    df = spark.createDataFrame([("h", "m", "x", 0.0, 5.0), ("h", "m", "x", 10.0, 9.0)],
                               "hotel string, metric string, model string, actual double, forecast double")
    r = O.holdout_metrics(df).first()
    assert (round(r.mape, 6), r.mae) == (0.1, 3.0)


def test_ensemble_needs_two_votes(spark):
    cols = "fc_adr double, ml_adr double, p_star double, action string, pressure_adr double, pressure_revpar double"
    df = spark.createDataFrame([(100.0, 110.0, 90.0, "RAISE", 1.0, 1.0), (100.0, 110.0, 90.0, "CUT", 1.0, 1.0),
                                (100.0, 90.0, 95.0, "HOLD", 0.8, 0.9)], cols)
    got = [(r.bar_recommend, r.final_action) for r in P.rate_ensemble(df).collect()]
    assert got == [(100.0, "RAISE"), (100.0, "HOLD"), (95.0, "CUT")]


def test_leaky_columns_are_refused(make):
    with pytest.raises(ValueError):
        M.booking_features(make([{}]), ["booking_key", "revenue"])


def test_split_is_exact_per_class_and_stable(make):
    df = make([{"is_canceled": int(i % 4 == 0), "lead_time": i} for i in range(200)])
    a = M.stratified_split(df, key=["booking_key"])
    b = M.stratified_split(df.repartition(3), key=["booking_key"])
    assert {r.booking_key for r in a.where("is_test = 1").collect()} == {r.booking_key for r in b.where("is_test = 1").collect()}
    assert {r.is_canceled: r["count"] for r in a.where("is_test = 1").groupBy("is_canceled").count().collect()} == {0: 30, 1: 10}
