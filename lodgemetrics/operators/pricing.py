"""Price elasticity, rate optimisation, scenario simulation and back-test.

Price grids live in arrays inside the row, so searching 161 prices adds no rows and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.functions.distribution import describe_by
from lodgemetrics.functions.exprs import (
    bookings, clamp, col, count_if, literal_rows, paid_stay, ratio, stayed,
)
from lodgemetrics.functions.special import t_two_sided
from lodgemetrics.schema import CITY, ELASTICITY_CLIP, ELASTICITY_PRIOR, RESORT

GRID, LOW, HIGH = 161, 0.70, 1.30


def prior(hotel: str | Column = "hotel") -> Column:
    chain = F.lit(None).cast("double")
    for name, eps in ELASTICITY_PRIOR.items():
        chain = F.when(col(hotel) == name, eps).otherwise(chain)
    return chain


def monthly_panel(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Hotel-month panel of paid stays with occupancy, cancel rate, mix shares and logs.

    One pass over all bookings: occupancy and the reference RevPAR come from the same groups, so
    no context join is needed.
    """
    paid = paid_stay()

    def mean(c: Column) -> Column:
        return F.avg(F.when(paid, c.cast("double")))

    def share(c: str, value: str) -> Column:
        return mean(F.when(F.col(c) == value, 1.0).otherwise(0.0))

    g = df.groupBy("hotel", *by, "year_month", F.col("arrival_month_number").alias("month_number")).agg(
        count_if(paid).alias("demand"), mean(F.col("adr")).alias("adr"),
        F.avg(1.0 - F.col("is_canceled")).alias("occ"),
        F.avg(F.when(stayed(), F.col("adr"))).alias("_group_adr"),
        mean(F.col("lead_time")).alias("lead_mean"), mean(F.col("total_nights")).alias("los_mean"),
        mean(F.col("total_of_special_requests")).alias("special_req"),
        share("market_segment", "Online TA").alias("share_online_ta"),
        share("market_segment", "Groups").alias("share_groups"),
        share("customer_type", "Transient").alias("share_transient"),
        bookings().alias("n_bookings"), F.avg(F.col("is_canceled").cast("double")).alias("cancel_rate"))
    g = g.where("demand > 0").withColumn("revpar", F.col("_group_adr") * F.col("occ")).drop("_group_adr")
    return g.withColumns({
        "season": bands.season("month_number"), "log_demand": F.log(F.greatest("demand", F.lit(1))),
        "log_adr": F.log(F.greatest("adr", F.lit(1e-3))),
        "log_revpar": F.log(F.greatest("revpar", F.lit(1e-3)))})


def with_lead_median(panel: DataFrame, stays: DataFrame) -> DataFrame:
    """Add the exact median lead time of the month's stays."""
    median = describe_by(stays, ["hotel", "year_month"], "lead_time", {"lead_p50": 0.5})
    return panel.join(median.select("hotel", "year_month", "lead_p50"), ["hotel", "year_month"], "left")


# --- elasticity

def _fit_columns(df: DataFrame, by: list[str], method: str, dof: Column) -> DataFrame:
    """Slope, SE, t, p, CI from within sums sxy, sxx, syy and the total sum of squares."""
    eps = ratio("sxy", "sxx")
    ssr = F.greatest(F.col("syy") - eps * F.col("sxy"), F.lit(0.0))
    out = df.withColumn("elasticity", eps).withColumn("_ssr", ssr).withColumn("_dof", dof)
    out = out.withColumn("std_err", F.sqrt(ratio(F.col("_ssr") / F.col("_dof"), "sxx")))
    out = out.withColumn("t_stat", ratio("elasticity", "std_err"))
    return out.select(
        *by, F.lit(method).alias("method"), "elasticity", "std_err", "t_stat",
        (1 - ratio("_ssr", "sst")).alias("r2"), F.col("n").alias("n_obs"), "_dof",
        (F.col("elasticity") - 1.96 * F.col("std_err")).alias("ci95_low"),
        (F.col("elasticity") + 1.96 * F.col("std_err")).alias("ci95_high"))


def _sums(x: str, y: str) -> list[Column]:
    a, b = F.col(x), F.col(y)
    return [F.count(F.lit(1)).alias("_n"), F.sum(a).alias("_x"), F.sum(b).alias("_y"),
            F.sum(a * a).alias("_xx"), F.sum(b * b).alias("_yy"), F.sum(a * b).alias("_xy")]


def elasticity_loglog_fe(panel: DataFrame, by: list[str] = ("hotel",),
                         method: str = "loglog_ols_month_fe", min_demand: int = 0) -> DataFrame:
    """OLS of log demand on log ADR with month-of-year effects.

    The effects are swept out first (within-month sums), which gives the same slope and
    residuals as the dummy regression from two small aggregates.
    """
    by = list(by)
    per_month = panel.groupBy(*by, "month_number").agg(*_sums("log_adr", "log_demand"), F.sum("demand").alias("_d"))

    def within(a: str, b: str, ab: str) -> Column:
        return F.sum(F.col(ab) - F.col(a) * F.col(b) / F.col("_n"))

    fit = per_month.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.sum("_d").alias("stays"), F.count(F.lit(1)).alias("months"),
        within("_x", "_x", "_xx").alias("sxx"),
        within("_y", "_y", "_yy").alias("syy"), within("_x", "_y", "_xy").alias("sxy"),
        (F.sum("_yy") - F.sum("_y") * F.sum("_y") / F.sum("_n")).alias("sst"))
    fit = fit.withColumn("sxx", F.when(F.col("sxx") > 1e-12, F.col("sxx")))
    fit = fit.where(F.col("stays") >= min_demand) if min_demand else fit
    return _fit_columns(fit, by, method, F.greatest(F.col("n") - F.col("months") - 1, F.lit(1)))


def elasticity_first_diff(panel: DataFrame, by: list[str] = ("hotel",)) -> DataFrame:
    """No-intercept slope of monthly log changes."""
    by = list(by)
    w = W.partitionBy(*by).orderBy("year_month")
    d = panel.select(*by, (F.col("log_adr") - F.lag("log_adr").over(w)).alias("dx"),
                     (F.col("log_demand") - F.lag("log_demand").over(w)).alias("dy")).na.drop()
    fit = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("dx") * F.col("dx")).alias("sxx"),
        F.sum(F.col("dy") * F.col("dy")).alias("syy"), F.sum(F.col("dx") * F.col("dy")).alias("sxy"))
    return _fit_columns(fit.withColumn("sst", F.col("syy")), by, "first_difference",
                        F.greatest(F.col("n") - 1, F.lit(1)))


def with_p_value(estimates: DataFrame) -> DataFrame:
    return estimates.withColumn("p_value", t_two_sided("t_stat", F.col("_dof").cast("double"))).drop("_dof")


def segment_cells(df: DataFrame, min_demand: int = 1) -> DataFrame:
    """Demand and ADR per hotel, segment and month of paid stays."""
    cells = df.where(paid_stay()).groupBy(
        "hotel", "market_segment", "year_month", F.col("arrival_month_number").alias("month_number")
    ).agg(F.count(F.lit(1)).alias("demand"), F.avg("adr").alias("adr"))
    return cells.where(F.col("demand") >= min_demand).withColumns({
        "log_demand": F.log(F.greatest("demand", F.lit(1))),
        "log_adr": F.log(F.greatest("adr", F.lit(1e-3)))})


def elasticity_pooled_segments(df: DataFrame, min_demand: int = 20, min_cells: int = 30) -> DataFrame:
    """Per hotel over segment-month cells: same month, different segments."""
    fit = elasticity_loglog_fe(segment_cells(df, min_demand), ["hotel"], "segment_loglog_month_fe")
    return fit.where(F.col("n_obs") >= min_cells)


def elasticity_by_segment(df: DataFrame, min_stays: int = 200, min_months: int = 8) -> DataFrame:
    """Per hotel and segment, with the prior when the slope is unusable."""
    by = ["hotel", "market_segment"]
    fit = elasticity_loglog_fe(segment_cells(df), by, min_demand=min_stays).where(F.col("n_obs") >= min_months)
    hat = F.col("elasticity")
    unusable = hat.isNull() | F.isnan(hat) | (hat >= 0) | (F.col("n_obs") < 10)
    out = fit.withColumn("elasticity_ops", F.when(unusable, prior()).otherwise(hat))
    return out.select(
        *by, hat.alias("elasticity_hat"), F.col("std_err").alias("se"), F.col("n_obs").alias("n_months"),
        "r2", "elasticity_ops", F.when(unusable, "rm_prior").otherwise("loglog_month_fe").alias("source"),
        F.when(F.abs("elasticity_ops") < 1, "inelastic").otherwise("elastic").alias("label"))


# Order in which estimates are tried.
PRIORITY = ["segment_loglog_month_fe", "loglog_ols_month_fe", "first_difference"]


def pick_elasticity(estimates: DataFrame) -> DataFrame:
    """First negative estimate by priority, else the prior; clipped to a safe range."""
    def of(method: str) -> Column:
        return F.max(F.when(F.col("method") == method, F.col("elasticity")))

    wide = estimates.groupBy("hotel").agg(*[of(m).alias(m) for m in PRIORITY])
    usable = [F.when((F.col(m) < 0) & ~F.isnan(m), F.col(m)) for m in PRIORITY]
    source = F.coalesce(*[F.when(u.isNotNull(), F.lit(m)) for u, m in zip(usable, PRIORITY)], F.lit("rm_prior"))
    return wide.select(
        "hotel", clamp(F.coalesce(*usable, prior()), *ELASTICITY_CLIP).alias("elasticity_primary"),
        source.alias("source_method"), F.col(PRIORITY[1]).alias("elasticity_loglog"),
        F.col(PRIORITY[2]).alias("elasticity_fd"), F.col(PRIORITY[0]).alias("elasticity_segment"))


def iso_elastic_curve(panel: DataFrame, primary: DataFrame, points: int = 80) -> DataFrame:
    """Q = q0 (p / p0)^eps between the 5th and 95th percentile of monthly ADR."""
    span = describe_by(panel, ["hotel"], "adr", {"p05": 0.05, "p95": 0.95})
    base = panel.groupBy("hotel").agg(F.avg("adr").alias("p0"), F.avg("demand").alias("q0"))
    rows = base.join(span.select("hotel", "p05", "p95"), "hotel").join(
        primary.select("hotel", "elasticity_primary"), "hotel")
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    price = F.col("p05") + F.col("step") * ((F.col("p95") - F.col("p05")) / (points - 1))
    return rows.select("hotel", "step", price.alias("price"), (
        F.col("q0") * F.pow(price / F.col("p0"), F.col("elasticity_primary"))).alias("demand"))


# --- price grid

def local_demand(p: Column, p0: Column, q0: Column, eps: Column) -> Column:
    """Linear demand around (p0, q0), between 5 % and 115 % of q0."""
    linear = q0 * (1.0 + F.try_divide(eps * (p - p0), p0))
    return F.least(F.greatest(linear, 0.05 * q0), 1.15 * q0)


def _grid_prices(p0: Column) -> Column:
    low, high = p0 * LOW, p0 * HIGH
    return F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda i: low + i * ((high - low) / (GRID - 1)))


def price_grid_optimize(df: DataFrame, p0: str = "adr", q0: str = "demand", eps: Column | None = None,
                        pressure: Column | None = None) -> DataFrame:
    """Add p_star, q_star, rev_star, rev_baseline, p_analytic; equal revenue takes the lowest price."""
    e = prior() if eps is None else eps
    push = F.lit(1.0) if pressure is None else pressure
    rows = df.withColumns({"_p0": F.col(p0).cast("double"), "_q0": F.col(q0).cast("double"), "_e": e})
    p, q, e = F.col("_p0"), F.col("_q0"), F.col("_e")

    def priced(price: Column) -> Column:
        demand = local_demand(price, p, q, e)
        return F.struct((price * demand).alias("rev"), (-price).alias("cheap"), price.alias("price"),
                        demand.alias("demand"))

    rows = rows.withColumn("_best", F.array_max(F.transform(_grid_prices(p), priced)))
    reference = p * clamp(0.70 + 0.30 * push, 0.80, 1.20)
    out = rows.withColumns({
        "elasticity": e, "p_star": F.col("_best.price"), "q_star": F.col("_best.demand"),
        "rev_star": F.col("_best.rev"), "rev_baseline": p * F.least(q, 1.15 * q),
        "p_analytic": F.when(e < 0, F.try_divide(p * (e - 1.0), 2.0 * e)).otherwise(reference)})
    out = out.withColumn("delta_price_pct", (ratio("p_star", p) - 1) * 100)
    out = out.withColumn("delta_revenue_pct", (ratio("rev_star", "rev_baseline") - 1) * 100)
    return out.withColumn("action", bands.action_from_delta("delta_price_pct")).drop("_p0", "_q0", "_e", "_best")


def optimal_rate_plan(bundle: DataFrame, primary: DataFrame) -> DataFrame:
    """Optimise each forecast month with the hotel's elasticity and blended pressure."""
    presses = [F.col(f"pressure_{m}") for m in ("adr", "revpar", "demand")]
    known = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in presses), F.lit(0))
    blend = ratio(sum((F.coalesce(c, F.lit(0.0)) for c in presses), F.lit(0.0)), known)
    rows = bundle.join(primary.select("hotel", "elasticity_primary"), "hotel").withColumn("pressure_blend", blend)
    return price_grid_optimize(rows, "fc_adr", "fc_demand", F.col("elasticity_primary"), F.col("pressure_blend"))


def rate_plan_summary(plan: DataFrame) -> DataFrame:
    """Mean price and revenue change per hotel and action, with the stances met there."""
    def stance(m: str, label: str) -> Column:
        return count_if(F.col(f"stance_{m}") == label).alias(f"{m}_{label.lower()}")
    return plan.groupBy("hotel", "action").agg(
        F.count(F.lit(1)).alias("n"), F.avg("delta_price_pct").alias("mean_delta_price"),
        F.avg("delta_revenue_pct").alias("mean_delta_revenue"),
        *[stance(m, s) for m in ("demand", "adr", "revpar") for s in ("PROTECT", "STIMULATE", "NEUTRAL")])


def rate_plan_pivot(plan: DataFrame) -> DataFrame:
    """City and Resort plan side by side per month."""
    def side(hotel: str, c: str) -> Column:
        return F.max(F.when(F.col("hotel") == hotel, F.col(c)))
    return plan.groupBy("year_month").agg(*[
        side(h, c).alias(f"{tag}_{c}") for h, tag in ((CITY, "city"), (RESORT, "resort"))
        for c in ("fc_adr", "p_star", "delta_price_pct", "action")])


# --- scenario simulation on the monthly fact

def scenario_simulate(monthly: DataFrame, adr_pct: float | Column = 5.0, occ_pp: float | Column = -2.0,
                      cancel_pp: float | Column = 0.0, elasticity: bool = False) -> DataFrame:
    """Shock every hotel-month and clamp it, before anything is rolled up."""
    adr_change = F.lit(adr_pct) / 100.0 if not isinstance(adr_pct, Column) else adr_pct / 100.0
    occ_change = (F.lit(occ_pp) if not isinstance(occ_pp, Column) else occ_pp) / 100.0
    cancel_change = (F.lit(cancel_pp) if not isinstance(cancel_pp, Column) else cancel_pp) / 100.0
    if elasticity:
        occ_change = occ_change + adr_change * -0.25
    occ1 = clamp(F.col("occupancy_rate") + occ_change, 0.05, 0.99)
    cancel_base = ratio("canceled_bookings", F.greatest("total_bookings", F.lit(1)))
    out = monthly.withColumns({
        "adr_sim": F.col("adr") * (1 + adr_change), "occ_sim": clamp(occ1 - cancel_change * 0.5, 0.05, 0.99),
        "cancel_sim": clamp(cancel_base + cancel_change, 0.0, 0.95),
        "revpar_base": F.col("adr") * F.col("occupancy_rate")})
    out = out.withColumn("revpar_sim", F.col("adr_sim") * F.col("occ_sim"))
    factor = F.coalesce(ratio("revpar_sim", "revpar_base"), F.lit(1.0))
    return out.withColumn("revenue_sim", F.col("total_revenue") * factor)


def _weighted(c: str) -> Column:
    return ratio(F.sum(F.col(c) * F.col("total_bookings")), F.sum("total_bookings"))


def scenario_total(sim: DataFrame, by: list[str] = ()) -> DataFrame:
    """Baseline against scenario: RevPAR, revenue, occupancy, ADR and cancel rate."""
    aggs = [
        _weighted("revpar_base").alias("revpar_baseline"), _weighted("revpar_sim").alias("revpar_scenario"),
        F.sum("total_revenue").alias("revenue_baseline"), F.sum("revenue_sim").alias("revenue_scenario"),
        _weighted("occ_sim").alias("occupancy_scenario"), _weighted("cancel_sim").alias("cancel_scenario"),
        ratio(F.sum(F.col("adr_sim") * F.col("successful_bookings")), F.sum("successful_bookings"))
        .alias("adr_scenario")]
    out = sim.groupBy(*by).agg(*aggs) if by else sim.agg(*aggs)
    return (out.withColumn("delta_revpar_pct", 100.0 * (ratio("revpar_scenario", "revpar_baseline") - 1))
            .withColumn("delta_revenue_pct", 100.0 * (ratio("revenue_scenario", "revenue_baseline") - 1)))


def scenario_by_month(sim: DataFrame) -> DataFrame:
    return scenario_total(sim, ["year_month"])


def sensitivity_4(monthly: DataFrame, adr_pct: float = 5.0, occ_pp: float = -2.0, cancel_pp: float = 0.0,
                  elasticity: bool = False, live: bool = False) -> DataFrame:
    """RevPAR of Baseline, ADR only, Occ only and Combined.

    Fixed variant: one clamp, no cancel lever. Live variant: all levers, double clamp; ADR only
    keeps the unclamped occupancy.
    """
    soft = adr_pct / 100 * -0.25 if elasticity else 0.0
    names = ["Baseline", "ADR only", "Occ only", "Combined"]
    rows = literal_rows([{"ord": i + 1, "scenario": n, "adr_mult": 1 + (adr_pct / 100 if i in (1, 3) else 0.0),
                          "shift": (occ_pp / 100 + soft) if i in (2, 3) else 0.0,
                          "cancel": cancel_pp / 100 if i in (2, 3) else 0.0} for i, n in enumerate(names)])
    s = monthly.select("adr", "occupancy_rate", "total_bookings", F.explode(rows).alias("s"))
    once = clamp(F.col("occupancy_rate") + F.col("s.shift"), 0.05, 0.99)
    if live:
        twice = clamp(once - F.col("s.cancel") * 0.5, 0.05, 0.99)
        occ = F.when(F.col("s.ord").isin(1, 2), F.col("occupancy_rate")).otherwise(twice)
    else:
        occ = once
    revpar = F.col("adr") * F.col("s.adr_mult") * occ * F.col("total_bookings")
    return (s.groupBy(F.col("s.ord").alias("scenario_order"), F.col("s.scenario").alias("scenario"))
            .agg(ratio(F.sum(revpar), F.sum("total_bookings")).alias("revpar")))


# --- validation on the panel

def _clip_occ(occ: Column) -> Column:
    return clamp(occ, 0.05, 0.99)


def revpar_simulation(panel: DataFrame) -> DataFrame:
    """Apply p* to every historical hotel-month."""
    out = price_grid_optimize(panel)
    occ = _clip_occ(F.col("occ") * (F.col("q_star") / F.col("demand")))
    out = out.withColumns({"revpar_base": F.col("adr") * F.col("occ"), "occ_sim": occ})
    out = out.withColumn("revpar_sim", F.col("p_star") * F.col("occ_sim"))
    return out.withColumn("delta_revpar_pct", 100.0 * (ratio("revpar_sim", "revpar_base") - 1)).select(
        "hotel", "year_month", "season", "elasticity", F.col("adr").alias("adr_base"), "p_star", "q_star",
        "occ_sim", "revpar_base", "revpar_sim", "delta_revpar_pct", "delta_revenue_pct", "delta_price_pct", "action")


def revpar_simulation_summary(sim: DataFrame) -> DataFrame:
    return sim.groupBy("hotel", "season").agg(
        F.count(F.lit(1)).alias("n"), F.avg("delta_revpar_pct").alias("mean_delta_revpar_pct"),
        F.avg("delta_revenue_pct").alias("mean_delta_rev_pct"),
        F.avg("delta_price_pct").alias("mean_delta_adr_pct"),
        F.avg("revpar_base").alias("mean_revpar_base"), F.avg("revpar_sim").alias("mean_revpar_sim"))


def whatif_ladder(df: DataFrame, shocks: list[float] = (0.05, 0.10, 0.15), min_n: int = 30) -> DataFrame:
    """Peak-season price shocks per hotel and segment."""
    peak = df.where(bands.season("arrival_month_number") == "Peak")
    paid = paid_stay()
    # occupancy is the hotel-month mean carried by each paid stay
    month = peak.groupBy("hotel", "year_month", "market_segment").agg(
        count_if(paid).alias("_d"), F.sum(F.when(paid, F.col("adr"))).alias("_adr"),
        bookings().alias("_n"), F.sum("is_canceled").alias("_cx"))
    hotel_month = W.partitionBy("hotel", "year_month")
    month = month.withColumn("_occ", 1 - F.sum("_cx").over(hotel_month) / F.sum("_n").over(hotel_month))
    agg = month.groupBy("hotel", "market_segment").agg(
        F.sum("_d").alias("n_stay"), F.sum("_n").alias("n_bookings"),
        ratio(F.sum("_adr"), F.sum("_d")).alias("adr_base"),
        ratio(F.sum(F.col("_occ") * F.col("_d")), F.sum("_d")).alias("_occ"),
        ratio(F.sum("_cx"), F.sum("_n")).alias("cancel_rate"))
    agg = agg.where((F.col("n_bookings") >= min_n) & (F.col("n_stay") > 0))
    rows = agg.withColumn("shock", F.explode(F.array(*[F.lit(float(s)) for s in shocks])))
    p0, q0 = F.col("adr_base"), F.col("n_stay").cast("double")
    p1 = p0 * (1.0 + F.col("shock"))
    rows = rows.withColumn("adr_shock", p1).withColumn("demand_shock", local_demand(p1, p0, q0, prior()))
    occ1 = _clip_occ(F.col("_occ") * (F.col("demand_shock") / q0))
    rows = rows.withColumns({"revpar_base": p0 * F.col("_occ"), "revpar_shock": F.col("adr_shock") * occ1})
    return rows.select(
        "hotel", "market_segment", (F.col("shock") * 100).alias("shock_pct"), "n_stay", "n_bookings",
        "adr_base", "adr_shock", "demand_shock", "cancel_rate",
        ((F.col("demand_shock") / q0 - 1) * 100).alias("delta_demand_pct"),
        ((F.col("adr_shock") * F.col("demand_shock") / (p0 * q0) - 1) * 100).alias("delta_rev_pct"),
        "revpar_base", "revpar_shock", (100.0 * (ratio("revpar_shock", "revpar_base") - 1)).alias("delta_revpar_pct"))


def whatif_summary(ladder: DataFrame) -> DataFrame:
    """Stay-weighted effect per hotel and shock."""
    def weighted(c: str) -> Column:
        return ratio(F.sum(F.col(c) * F.col("n_stay")), F.sum("n_stay")).alias(c)
    return ladder.groupBy("hotel", "shock_pct").agg(
        *[weighted(c) for c in ("delta_revpar_pct", "delta_demand_pct", "delta_rev_pct")])


def risk_slope(panel: DataFrame, min_rows: int = 8, fallback: float = 0.05) -> DataFrame:
    """d cancel rate / d log ADR per hotel."""
    slope = F.regr_slope("cancel_rate", "log_adr")
    usable = (F.count(F.lit(1)) >= min_rows) & (F.stddev_pop("log_adr") > 0)
    return panel.groupBy("hotel").agg(F.when(usable, slope).otherwise(F.lit(fallback)).alias("risk_slope"))


def with_risk_slope(panel: DataFrame, min_rows: int = 8, fallback: float = 0.05) -> DataFrame:
    """risk_slope as a panel column: a window over a hotel's months instead of a second pass."""
    w = W.partitionBy("hotel")
    usable = (F.count(F.lit(1)).over(w) >= min_rows) & (F.stddev_pop("log_adr").over(w) > 0)
    slope = F.when(usable, F.regr_slope("cancel_rate", "log_adr").over(w)).otherwise(F.lit(fallback))
    return panel.withColumn("risk_slope", slope)


def dual_optimize(panel: DataFrame, alphas: list[float] = (0.7,)) -> DataFrame:
    """Price that balances normalised revenue against normalised cancel risk.

    ``panel`` carries risk_slope.
    """
    rows = panel.withColumn("_e", prior())
    rows = rows.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    p0, q0 = F.col("adr"), F.col("demand").cast("double")

    def point(price: Column) -> Column:
        rev = price * local_demand(price, p0, q0, F.col("_e"))
        risk = clamp(F.col("cancel_rate") + F.col("risk_slope") * F.log(price / p0), 0.01, 0.95)
        return F.struct(price.alias("price"), rev.alias("rev"), risk.alias("risk"))

    rows = rows.withColumn("_g", F.transform(_grid_prices(p0), point))
    rows = rows.withColumns({f"_{f}_{name}": fn(F.col("_g")[f])
                             for f in ("rev", "risk") for name, fn in (("lo", F.array_min), ("hi", F.array_max))})

    def norm(g: Column, f: str) -> Column:
        return (g[f] - F.col(f"_{f}_lo")) / (F.col(f"_{f}_hi") - F.col(f"_{f}_lo") + 1e-12)

    def scored(g: Column) -> Column:
        score = F.col("alpha") * norm(g, "rev") - (1 - F.col("alpha")) * norm(g, "risk")
        return F.struct(F.round(score, 12).alias("score"), (-g["price"]).alias("cheap"), g.alias("g"))

    def by_revenue(g: Column) -> Column:
        return F.struct(g["rev"].alias("score"), (-g["price"]).alias("cheap"), g.alias("g"))

    rows = rows.withColumns({"_dual": F.array_max(F.transform("_g", scored))["g"],
                             "_rev": F.array_max(F.transform("_g", by_revenue))["g"]})
    return rows.select(
        "hotel", "year_month", "season", "demand", "alpha", p0.alias("p0"), F.col("cancel_rate").alias("cancel0"),
        F.col("_rev.price").alias("p_star_rev"), F.col("_dual.price").alias("p_star_dual"),
        ((F.col("_dual.price") / F.col("_rev.price") - 1) * 100).alias("delta_dual_vs_rev_pct"),
        F.col("_rev.risk").alias("risk_revopt"), F.col("_dual.risk").alias("risk_dual"),
        F.col("_rev.rev").alias("rev_revopt"), F.col("_dual.rev").alias("rev_dual"))


def dual_alpha_sensitivity(panel: DataFrame, alphas: list[float] = (0.5, 0.7, 0.9)) -> DataFrame:
    """The busiest peak month of each hotel under different weights."""
    w = W.partitionBy("hotel").orderBy(F.desc("demand"), F.desc("year_month"))
    busiest = (panel.where("season = 'Peak'").withColumn("_rn", F.row_number().over(w))
               .where("_rn = 1").drop("_rn"))
    return dual_optimize(busiest, alphas).select(
        "hotel", "year_month", "alpha", "p_star_dual", F.col("risk_dual").alias("risk"), F.col("rev_dual").alias("rev"))


def backtest_rules(panel: DataFrame, month_from: str = "2015-07", month_to: str = "2016-12") -> DataFrame:
    """Replay City Peak +10 % and Resort Low -5 % on history; ``panel`` carries risk_slope."""
    mult = (F.when((F.col("hotel") == CITY) & (F.col("season") == "Peak"), 1.10)
            .when((F.col("hotel") == RESORT) & (F.col("season") == "Low"), 0.95).otherwise(1.00))
    rows = panel.where(F.col("year_month").between(month_from, month_to))
    rows = rows.withColumn("rule_mult", mult)
    p0, q0 = F.col("adr"), F.col("demand").cast("double")
    rows = rows.withColumn("adr_rule", p0 * F.col("rule_mult"))
    rows = rows.withColumn("_q", local_demand(F.col("adr_rule"), p0, q0, prior()))
    risk = clamp(F.col("cancel_rate") + F.col("risk_slope") * F.log(F.greatest(F.col("adr_rule") / p0, F.lit(1e-9))),
                 0.01, 0.95)
    rows = rows.withColumns({
        "revpar_base": p0 * F.col("occ"), "cancel_rule": risk,
        "revpar_rule": F.col("adr_rule") * _clip_occ(F.col("occ") * (F.col("_q") / q0))})
    return rows.select(
        "hotel", "year_month", "season", "rule_mult",
        bands.action_from_delta(F.round((F.col("rule_mult") - 1) * 100, 6)).alias("action"),
        p0.alias("adr_base"), "adr_rule", "revpar_base", "revpar_rule",
        (100.0 * (ratio("revpar_rule", "revpar_base") - 1)).alias("delta_revpar_pct"),
        F.col("cancel_rate").alias("cancel_base"), "cancel_rule",
        ((F.col("cancel_rule") - F.col("cancel_rate")) * 100).alias("delta_cancel_pp"),
        ((F.col("adr_rule") * F.col("_q") / (p0 * q0) - 1) * 100).alias("delta_rev_pct"))


def _win() -> Column:
    """Gains below a billionth of a percent are rounding, not wins."""
    return F.avg(F.when(F.col("delta_revpar_pct") > 1e-9, 1.0).otherwise(0.0))


def backtest_summary(bt: DataFrame) -> DataFrame:
    return bt.groupBy("hotel", "season").agg(
        F.count(F.lit(1)).alias("n"), F.avg("delta_revpar_pct").alias("mean_delta_revpar"),
        F.avg("delta_rev_pct").alias("mean_delta_rev"), F.avg("delta_cancel_pp").alias("mean_delta_cancel_pp"),
        _win().alias("win_rate"))


def go_nogo_gates(bt: DataFrame) -> DataFrame:
    """Gates: RevPAR not worse, City peak not worse, cancel rate at most 1 pp up."""
    peak = F.avg(F.when(F.col("season") == "Peak", F.col("delta_revpar_pct")))
    g = bt.groupBy("hotel").agg(
        F.avg("delta_revpar_pct").alias("mean_delta_revpar_all"), peak.alias("mean_delta_revpar_peak"),
        F.avg("delta_cancel_pp").alias("mean_delta_cancel_pp"), _win().alias("win_rate"))
    floor = F.lit(-1e-9)
    gates = {
        "pass_revpar": F.col("mean_delta_revpar_all") >= floor,
        "pass_peak_city": (F.col("hotel") != CITY) | F.coalesce(F.col("mean_delta_revpar_peak") >= floor, F.lit(False)),
        "pass_cancel": F.col("mean_delta_cancel_pp") <= 1.0,
    }
    g = g.withColumns({k: v.cast("int") for k, v in gates.items()})
    return g.withColumn("go", F.least(*gates))


# --- features and the final recommendation

def lag_features(panel: DataFrame) -> DataFrame:
    """Lags 1 and 12, mean of the three previous months, next month's ADR."""
    w = W.partitionBy("hotel").orderBy("year_month")
    before = w.rowsBetween(-3, -1)
    cols = {f"{c}_lag{k}": F.lag(c, k).over(w) for c in ("demand", "adr", "revpar", "occ", "lead_mean") for k in (1, 12)}
    return panel.withColumns({
        **cols, "adr_roll3": F.avg("adr").over(before), "demand_roll3": F.avg("demand").over(before),
        "adr_next": F.lead("adr").over(w), "hotel_code": (F.col("hotel") == RESORT).cast("int")})


def stance_labels_hist(panel: DataFrame) -> DataFrame:
    """Historical pressure and its stance: up to 0.9 stimulate, above 1.1 protect."""
    mean = F.avg("demand").over(W.partitionBy("hotel"))
    season = F.avg("demand").over(W.partitionBy("hotel", "month_number")) / mean
    out = panel.withColumn("pressure_hist", 0.5 * season + 0.5 * (F.col("demand") / mean))
    label = (F.when(F.col("pressure_hist") <= 0.9, "STIMULATE").when(F.col("pressure_hist") <= 1.1, "NEUTRAL")
             .otherwise("PROTECT"))
    return out.withColumn("stance_hist", label)


def rate_ensemble(plan: DataFrame, ml_adr: str = "ml_adr") -> DataFrame:
    """Median of forecast, model and optimal rate with a 15 % band and a two-of-three vote."""
    middle = F.array_sort(F.array("fc_adr", ml_adr, "p_star"))[1]

    def vote(up: Column, down: Column) -> Column:
        return F.when(up, 1).when(down, -1).otherwise(0)

    press = 0.5 * F.col("pressure_adr") + 0.5 * F.col("pressure_revpar")
    votes = F.array(vote(F.col(ml_adr) > F.col("fc_adr") * 1.03, F.col(ml_adr) < F.col("fc_adr") * 0.97),
                    vote(F.col("action") == "RAISE", F.col("action") == "CUT"),
                    vote(press >= 1.1, press <= 0.9))
    ups = F.size(F.filter(votes, lambda v: v == 1))
    downs = F.size(F.filter(votes, lambda v: v == -1))
    final = F.when(ups >= 2, "RAISE").when(downs >= 2, "CUT").otherwise("HOLD")
    return plan.withColumn("bar_recommend", middle).withColumns({
        "bar_floor": 0.85 * F.col("bar_recommend"), "bar_ceil": 1.15 * F.col("bar_recommend"), "final_action": final})
