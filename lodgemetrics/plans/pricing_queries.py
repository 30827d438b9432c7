"""Catalog entries: elasticity, optimisation, scenarios, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.operators import forecast as O
from lodgemetrics.operators import kpi as K
from lodgemetrics.operators import pricing as P
from lodgemetrics.plans.catalog import Catalog

FIT6 = "elasticity std_err t_stat r2 ci95_low ci95_high"
PRIOR = "CASE WHEN hotel = 'City Hotel' THEN -0.70 ELSE -1.10 END"


def _fe_sql(method: str, source: str, by: str = "hotel") -> str:
    return f"""SELECT {by}, '{method}' AS method, eps AS elasticity, se AS std_err, eps / se AS t_stat, r2, n AS n_obs,
      eps - 1.96 * se AS ci95_low, eps + 1.96 * se AS ci95_high FROM (
      SELECT *, sxy / sxx AS eps, sqrt((syy - sxy / sxx * sxy) / greatest(n - k - 1, 1) / sxx) AS se,
        1 - (syy - sxy / sxx * sxy) / sst AS r2 FROM (
        SELECT {by}, count(*) AS n, count(DISTINCT month_number) AS k, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy,
          var_pop(log_demand) * count(*) AS sst FROM (SELECT *,
          log_adr - avg(log_adr) OVER (PARTITION BY {by}, month_number) AS x,
          log_demand - avg(log_demand) OVER (PARTITION BY {by}, month_number) AS y FROM {source}) GROUP BY {by}))"""


FE = _fe_sql("loglog_ols_month_fe", "pan ")
POOLED = f"SELECT * FROM ({_fe_sql('segment_loglog_month_fe', '(SELECT * FROM segpan WHERE demand >= 20)')}) WHERE n_obs >= 30"
FD = """SELECT hotel, 'first_difference' AS method, eps AS elasticity, se AS std_err, eps / se AS t_stat, r2, n AS n_obs,
  eps - 1.96 * se AS ci95_low, eps + 1.96 * se AS ci95_high FROM (
  SELECT hotel, count(*) AS n, sum(x * y) / sum(x * x) AS eps,
    sqrt((sum(y * y) - sum(x * y) / sum(x * x) * sum(x * y)) / greatest(count(*) - 1, 1) / sum(x * x)) AS se,
    1 - (sum(y * y) - sum(x * y) / sum(x * x) * sum(x * y)) / sum(y * y) AS r2 FROM (
    SELECT hotel, log_adr - lag(log_adr) OVER w AS x, log_demand - lag(log_demand) OVER w AS y FROM pan
    WINDOW w AS (PARTITION BY hotel ORDER BY year_month)) WHERE x IS NOT NULL GROUP BY hotel)"""
PICK = f"""SELECT hotel, greatest(-2.5, least(-0.15, coalesce(CASE WHEN s < 0 THEN s END, CASE WHEN l < 0 THEN l END,
  CASE WHEN d < 0 THEN d END, {PRIOR}))) AS elasticity_primary,
  CASE WHEN s < 0 THEN 'segment_loglog_month_fe' WHEN l < 0 THEN 'loglog_ols_month_fe' WHEN d < 0 THEN 'first_difference'
  ELSE 'rm_prior' END AS source_method, l AS elasticity_loglog, d AS elasticity_fd, s AS elasticity_segment FROM (
  SELECT hotel, max(elasticity) FILTER (method = 'segment_loglog_month_fe') AS s,
    max(elasticity) FILTER (method = 'loglog_ols_month_fe') AS l, max(elasticity) FILTER (method = 'first_difference') AS d
  FROM ({FE} UNION ALL {FD} UNION ALL {POOLED}) GROUP BY hotel)"""


def _grid_sql(source: str, p0: str, q0: str, eps: str, press: str = "1.0") -> str:
    price = f"({p0} * 0.7 + i * (({p0} * 1.3 - {p0} * 0.7) / 160))"
    demand = f"least(greatest({q0} * (1.0 + eps * (price - {p0}) / {p0}), 0.05 * {q0}), 1.15 * {q0})"
    return f"""SELECT * EXCLUDE (i, price, qty, eps), eps AS elasticity, price AS p_star, qty AS q_star, price * qty AS rev_star,
      {p0} * {q0} AS rev_baseline, {p0} * (eps - 1.0) / (2.0 * eps) AS p_analytic, (price / {p0} - 1) * 100 AS delta_price_pct,
      (price * qty / ({p0} * {q0}) - 1) * 100 AS delta_revenue_pct, CASE WHEN (price / {p0} - 1) * 100 >= 3 THEN 'RAISE'
      WHEN (price / {p0} - 1) * 100 <= -3 THEN 'CUT' ELSE 'HOLD' END AS action FROM (
      SELECT *, {demand} AS qty FROM (SELECT s.*, i, {eps} AS eps, {price} AS price FROM {source} s, generate_series(0, 160) g(i)))
      QUALIFY row_number() OVER (PARTITION BY hotel, year_month ORDER BY price * qty DESC, price) = 1"""


PLAN = _grid_sql(f"""(SELECT c.*, e.elasticity_primary, (pressure_adr + pressure_revpar + pressure_demand) / 3 AS pressure_blend
  FROM bundle c JOIN ({PICK}) e ON e.hotel = c.hotel)""", "fc_adr", "fc_demand", "elasticity_primary")
PLAN6 = """fc_demand fc_adr fc_revpar pressure_demand pressure_adr pressure_revpar pressure_blend elasticity_primary elasticity
  p_star q_star p_analytic delta_price_pct delta_revenue_pct"""
SIM_COLS = """adr * {m} AS adr_sim, least(0.99, greatest(0.05, least(0.99, greatest(0.05, occupancy_rate + {o})) - {c} * 0.5)) AS occ_sim,
  least(0.95, greatest(0.0, canceled_bookings / greatest(total_bookings, 1) + {c})) AS cancel_sim, adr * occupancy_rate AS revpar_base"""


def _sim_sql(adr: float, occ: float, cx: float, soft: bool = False) -> str:
    cols = SIM_COLS.format(m=1 + adr / 100, o=occ / 100 + (adr / 100 * -0.25 if soft else 0), c=cx / 100)
    return f"""SELECT *, adr_sim * occ_sim AS revpar_sim, total_revenue * coalesce(adr_sim * occ_sim / nullif(revpar_base, 0), 1)
      AS revenue_sim FROM (SELECT hotel, year_month, total_bookings, successful_bookings, total_revenue, adr, occupancy_rate,
      {cols} FROM mon )"""


TOTAL = """*, 100.0 * (revpar_scenario / revpar_baseline - 1) AS delta_revpar_pct,
  100.0 * (revenue_scenario / revenue_baseline - 1) AS delta_revenue_pct FROM (SELECT {k}
  sum(revpar_base * total_bookings) / sum(total_bookings) AS revpar_baseline,
  sum(revpar_sim * total_bookings) / sum(total_bookings) AS revpar_scenario, sum(total_revenue) AS revenue_baseline,
  sum(revenue_sim) AS revenue_scenario, sum(occ_sim * total_bookings) / sum(total_bookings) AS occupancy_scenario,
  sum(cancel_sim * total_bookings) / sum(total_bookings) AS cancel_scenario,
  sum(adr_sim * successful_bookings) / nullif(sum(successful_bookings), 0) AS adr_scenario FROM ({s}) {g})"""
TOTAL6 = """revpar_baseline revpar_scenario occupancy_scenario cancel_scenario adr_scenario delta_revpar_pct
  delta_revenue_pct"""
SENS = """SELECT {i} AS scenario_order, '{n}' AS scenario, sum(adr * {m} * {o} * total_bookings) / sum(total_bookings) AS revpar FROM mon """
CLIP = "least(0.99, greatest(0.05, {}))"
QD = "least(greatest(q0 * (1.0 + eps * (p1 - p0) / p0), 0.05 * q0), 1.15 * q0)"
SIMHIST = f"""SELECT hotel, year_month, season, elasticity, adr AS adr_base, p_star, q_star, occ_sim, adr * occ AS revpar_base,
  p_star * occ_sim AS revpar_sim, 100.0 * (p_star * occ_sim / (adr * occ) - 1) AS delta_revpar_pct, delta_revenue_pct,
  delta_price_pct, action FROM (SELECT *, {CLIP.format('occ * (q_star / demand)')} AS occ_sim FROM ({_grid_sql('pan ', 'adr', 'demand', PRIOR)}))"""
LADDER = f"""SELECT hotel, market_segment, shock * 100 AS shock_pct, q0 AS n_stay, n_bookings, p0 AS adr_base, p1 AS adr_shock,
  q1 AS demand_shock, cancel_rate, (q1 / q0 - 1) * 100 AS delta_demand_pct, (p1 * q1 / (p0 * q0) - 1) * 100 AS delta_rev_pct,
  p0 * occ AS revpar_base, p1 * {CLIP.format('occ * (q1 / q0)')} AS revpar_shock,
  100.0 * (p1 * {CLIP.format('occ * (q1 / q0)')} / (p0 * occ) - 1) AS delta_revpar_pct FROM (
  SELECT *, {QD} AS q1 FROM (SELECT *, p0 * (1.0 + shock) AS p1, {PRIOR} AS eps FROM (
  SELECT hotel, market_segment, count(*) FILTER (is_canceled = 0 AND adr > 0) AS q0, count(*) AS n_bookings,
    avg(adr) FILTER (is_canceled = 0 AND adr > 0) AS p0, avg(occupancy_rate) FILTER (is_canceled = 0 AND adr > 0) AS occ,
    avg(is_canceled) AS cancel_rate FROM ctx WHERE arrival_month_number IN (7, 8) GROUP BY 1, 2 HAVING count(*) >= 30),
  (SELECT unnest([0.05, 0.10, 0.15])::DOUBLE AS shock)))"""
LADDER6 = """shock_pct adr_base adr_shock demand_shock cancel_rate delta_demand_pct delta_rev_pct revpar_base revpar_shock
  delta_revpar_pct"""


def _dual_sql(source: str, alphas: str) -> str:
    return f"""WITH g AS (SELECT *, price * least(greatest(demand * (1.0 + eps * (price - p0) / p0), 0.05 * demand), 1.15 * demand) AS rev,
        least(0.95, greatest(0.01, cancel_rate + risk_slope * ln(price / p0))) AS risk FROM (
        SELECT s.hotel, s.year_month, s.season, s.demand, s.cancel_rate, s.adr AS p0, k.risk_slope, alpha, i,
          CASE WHEN s.hotel = 'City Hotel' THEN -0.70 ELSE -1.10 END AS eps,
          s.adr * 0.7 + i * ((s.adr * 1.3 - s.adr * 0.7) / 160) AS price FROM {source} s JOIN slopes k ON k.hotel = s.hotel,
          (SELECT unnest([{alphas}])::DOUBLE AS alpha), generate_series(0, 160) t(i))),
      z AS (SELECT *, round(alpha * (rev - min(rev) OVER w) / (max(rev) OVER w - min(rev) OVER w + 1e-12)
        - (1 - alpha) * ((risk - min(risk) OVER w) / (max(risk) OVER w - min(risk) OVER w + 1e-12)), 12) AS score FROM g
        WINDOW w AS (PARTITION BY hotel, year_month, alpha)),
      r AS (SELECT *, row_number() OVER (PARTITION BY hotel, year_month, alpha ORDER BY score DESC, price) AS rd,
        row_number() OVER (PARTITION BY hotel, year_month, alpha ORDER BY rev DESC, price) AS rr FROM z)
      SELECT d.hotel, d.year_month, d.season, d.demand, d.alpha, d.p0, d.cancel_rate AS cancel0, v.price AS p_star_rev,
        d.price AS p_star_dual, (d.price / v.price - 1) * 100 AS delta_dual_vs_rev_pct, v.risk AS risk_revopt,
        d.risk AS risk_dual, v.rev AS rev_revopt, d.rev AS rev_dual FROM r d JOIN r v ON v.hotel = d.hotel
        AND v.year_month = d.year_month AND v.alpha = d.alpha AND v.rr = 1 WHERE d.rd = 1"""


MULT = """CASE WHEN hotel = 'City Hotel' AND season = 'Peak' THEN 1.10 WHEN hotel = 'Resort Hotel' AND season = 'Low' THEN 0.95
  ELSE 1.00 END::DOUBLE"""
SPAN = ("1996-07", "1997-12")
BACKTEST = f"""SELECT hotel, year_month, season, mult AS rule_mult, CASE WHEN mult >= 1.03 THEN 'RAISE' WHEN mult <= 0.97 THEN 'CUT'
  ELSE 'HOLD' END AS action, p0 AS adr_base, p1 AS adr_rule, p0 * occ AS revpar_base,
  p1 * {CLIP.format('occ * (q1 / q0)')} AS revpar_rule, 100.0 * (p1 * {CLIP.format('occ * (q1 / q0)')} / (p0 * occ) - 1) AS delta_revpar_pct,
  cancel_rate AS cancel_base, risk AS cancel_rule, (risk - cancel_rate) * 100 AS delta_cancel_pp,
  (p1 * q1 / (p0 * q0) - 1) * 100 AS delta_rev_pct FROM (SELECT *, {QD} AS q1,
    least(0.95, greatest(0.01, cancel_rate + risk_slope * ln(greatest(p1 / p0, 1e-9)))) AS risk FROM (
    SELECT p.hotel, year_month, season, adr AS p0, demand AS q0, occ, cancel_rate, risk_slope, {MULT.replace('hotel', 'p.hotel')} AS mult,
      adr * {MULT.replace('hotel', 'p.hotel')} AS p1, {PRIOR.replace('hotel', 'p.hotel')} AS eps FROM pan p JOIN slopes k ON k.hotel = p.hotel
    WHERE year_month BETWEEN '{SPAN[0]}' AND '{SPAN[1]}'))"""
LAG_COLS = ("demand", "adr", "revpar", "occ", "lead_mean")


def _estimates(x) -> DataFrame:
    panel = P.monthly_panel(x.bookings())
    parts = [P.elasticity_loglog_fe(panel), P.elasticity_first_diff(panel), P.elasticity_pooled_segments(x.bookings())]
    return reduce(DataFrame.unionByName, parts)


def _bundle(x) -> DataFrame:
    series = O.monthly_series(x.bookings(), metrics=["demand", "adr", "revpar"])
    return O.forecast_bundle(series, O.seasonal_naive(series))


def _plan(x) -> DataFrame:
    return P.optimal_rate_plan(_bundle(x), P.pick_elasticity(_estimates(x)).select("hotel", "elasticity_primary"))


def _backtest(x) -> DataFrame:
    return P.backtest_rules(P.with_risk_slope(P.monthly_panel(x.bookings())), *SPAN)


def _ensemble(x) -> DataFrame:
    ml = F.col("fc_adr") * (1 + 0.06 * (F.col("month_number") % 3 - 1))
    return P.rate_ensemble(_plan(x).withColumn("ml_adr", ml)).select(
        "hotel", "year_month", "fc_adr", "ml_adr", "p_star", "action", "bar_recommend", "bar_floor", "bar_ceil", "final_action")


def register(cat: Catalog) -> None:
    add = cat.add
    panel = lambda x: P.monthly_panel(x.bookings())
    add("monthly_panel", lambda x: P.with_lead_median(panel(x), x.stays()),
        """SELECT p.*, l.lead_p50 FROM pan p JOIN (SELECT hotel, year_month, quantile_cont(lead_time, 0.5) AS lead_p50
        FROM stays GROUP BY 1, 2) l ON l.hotel = p.hotel AND l.year_month = p.year_month""",
        r6="""adr occ revpar lead_mean los_mean special_req share_online_ta share_groups share_transient cancel_rate log_demand
        log_adr log_revpar lead_p50""")
    add("elasticity_loglog_fe", lambda x: P.elasticity_loglog_fe(panel(x)).drop("_dof"), FE, r6=FIT6)
    add("elasticity_first_diff", lambda x: P.elasticity_first_diff(panel(x)).drop("_dof"), FD, r6=FIT6)
    add("elasticity_pooled_segments", lambda x: P.elasticity_pooled_segments(x.bookings()).drop("_dof"), POOLED, r6=FIT6)
    add("elasticity_by_segment", lambda x: P.elasticity_by_segment(x.bookings()),
        f"""SELECT *, CASE WHEN abs(elasticity_ops) < 1 THEN 'inelastic' ELSE 'elastic' END AS label FROM (
        SELECT hotel, market_segment, elasticity AS elasticity_hat, std_err AS se, n_obs AS n_months, r2,
        CASE WHEN elasticity >= 0 OR n_obs < 10 THEN {PRIOR} ELSE elasticity END AS elasticity_ops,
        CASE WHEN elasticity >= 0 OR n_obs < 10 THEN 'rm_prior' ELSE 'loglog_month_fe' END AS source
        FROM ({_fe_sql('s', 'segpan ', 'hotel, market_segment')}) WHERE n_obs >= 8 AND (hotel, market_segment) IN (
          SELECT (hotel, market_segment) FROM segpan GROUP BY hotel, market_segment HAVING sum(demand) >= 200))""",
        r6="elasticity_hat se r2 elasticity_ops")
    add("elasticity_p_values", lambda x: P.with_p_value(_estimates(x)))
    add("pick_elasticity", lambda x: P.pick_elasticity(_estimates(x)), PICK,
        r6="elasticity_primary elasticity_loglog elasticity_fd elasticity_segment")
    add("iso_elastic_curve", lambda x: P.iso_elastic_curve(panel(x), P.pick_elasticity(_estimates(x))),
        f"""SELECT hotel, step, price, q0 * (price / p0) ** e AS demand FROM (SELECT c.hotel, CAST(step AS INTEGER) AS step, p0, q0,
        e.elasticity_primary AS e, lo + step * ((hi - lo) / 79) AS price FROM (SELECT hotel, avg(adr) AS p0, avg(demand) AS q0,
        quantile_cont(adr, 0.05) AS lo, quantile_cont(adr, 0.95) AS hi FROM pan GROUP BY hotel) c JOIN ({PICK}) e
        ON e.hotel = c.hotel, generate_series(0, 79) g(step))""", r6="price demand")
    add("price_grid_optimize", lambda x: P.price_grid_optimize(panel(x)).select(
            "hotel", "year_month", "adr", "demand", "elasticity", "p_star", "q_star", "rev_star", "rev_baseline", "p_analytic",
            "delta_price_pct", "delta_revenue_pct", "action"),
        f"""SELECT hotel, year_month, adr, demand, elasticity, p_star, q_star, rev_star, rev_baseline, p_analytic, delta_price_pct,
        delta_revenue_pct, action FROM ({_grid_sql('pan ', 'adr', 'demand', PRIOR)})""",
        r6="adr elasticity p_star q_star p_analytic delta_price_pct delta_revenue_pct", r4="rev_star rev_baseline")
    add("action_from_delta", lambda x: K.monthly_revenue_mom(x.monthly()).where("revenue_mom_pct IS NOT NULL").select(
            "year_month", "revenue_mom_pct", bands.action_from_delta("revenue_mom_pct").alias("action")),
        """SELECT *, CASE WHEN revenue_mom_pct >= 3 THEN 'RAISE' WHEN revenue_mom_pct <= -3 THEN 'CUT' ELSE 'HOLD' END AS action
        FROM (SELECT year_month, 100.0 * (r - lag(r) OVER (ORDER BY year_month)) / lag(r) OVER (ORDER BY year_month) AS revenue_mom_pct
        FROM (SELECT year_month, sum(revenue) AS r FROM b GROUP BY 1)) WHERE revenue_mom_pct IS NOT NULL""", r6="revenue_mom_pct")
    add("optimal_rate_plan", _plan, PLAN, r6=PLAN6, r4="rev_star rev_baseline")
    stance_counts = ", ".join(f"count(*) FILTER (stance_{m} = '{s}') AS {m}_{s.lower()}"
                              for m in ("demand", "adr", "revpar") for s in ("PROTECT", "STIMULATE", "NEUTRAL"))
    add("rate_plan_summary", lambda x: P.rate_plan_summary(_plan(x)),
        f"""SELECT hotel, action, count(*) AS n, avg(delta_price_pct) AS mean_delta_price, avg(delta_revenue_pct) AS mean_delta_revenue,
        {stance_counts} FROM ({PLAN}) GROUP BY hotel, action""", r6="mean_delta_price mean_delta_revenue")
    picks = ", ".join(f"max({c}) FILTER (hotel = '{h} Hotel') AS {h.lower()}_{c}" for h in ("City", "Resort")
                      for c in ("fc_adr", "p_star", "delta_price_pct", "action"))
    add("rate_plan_pivot", lambda x: P.rate_plan_pivot(_plan(x)), f"SELECT year_month, {picks} FROM ({PLAN}) GROUP BY 1",
        r6=" ".join(f"{h}_{c}" for h in ("city", "resort") for c in ("fc_adr", "p_star", "delta_price_pct")))
    # --- scenarios
    add("scenario_simulate", lambda x: P.scenario_simulate(x.monthly(), 5, -2, 3).select(
            "hotel", "year_month", "total_bookings", "successful_bookings", "total_revenue", "adr", "occupancy_rate",
            "adr_sim", "occ_sim", "cancel_sim", "revpar_base", "revpar_sim", "revenue_sim"), _sim_sql(5, -2, 3),
        r6="adr occupancy_rate adr_sim occ_sim cancel_sim revpar_base revpar_sim", r4="total_revenue revenue_sim")
    for name, levers, soft in (("default", (5, -2, 0), False), ("elastic", (12, 0, 4), True), ("zero", (0, 0, 0), False)):
        add(f"scenario_total_{name}", lambda x, v=levers, s=soft: P.scenario_total(P.scenario_simulate(x.monthly(), *v, s)),
            "SELECT " + TOTAL.format(k="", s=_sim_sql(*levers, soft), g=""), r6=TOTAL6, r4="revenue_baseline revenue_scenario")
    add("scenario_by_month", lambda x: P.scenario_by_month(P.scenario_simulate(x.monthly())),
        "SELECT " + TOTAL.format(k="year_month,", s=_sim_sql(5, -2, 0), g="GROUP BY year_month"), r6=TOTAL6,
        r4="revenue_baseline revenue_scenario")
    once = CLIP.format("occupancy_rate + {}")
    fixed = [("Baseline", 1, 0), ("ADR only", 1.05, 0), ("Occ only", 1, -0.02), ("Combined", 1.05, -0.02)]
    add("sensitivity_4", lambda x: P.sensitivity_4(x.monthly()), " UNION ALL ".join(
        SENS.format(i=i + 1, n=n, m=m, o=once.format(o)) for i, (n, m, o) in enumerate(fixed)), r6="revpar")
    twice = CLIP.format(once.format(-0.04 + 0.08 * -0.25) + " - 0.02 * 0.5")
    live = [("Baseline", 1, "occupancy_rate"), ("ADR only", 1.08, "occupancy_rate"), ("Occ only", 1, twice), ("Combined", 1.08, twice)]
    add("sensitivity_4_live", lambda x: P.sensitivity_4(x.monthly(), 8, -4, 2, True, True), " UNION ALL ".join(
        SENS.format(i=i + 1, n=n, m=m, o=o) for i, (n, m, o) in enumerate(live)), r6="revpar")
    # --- validation
    sim6 = "elasticity adr_base p_star q_star occ_sim revpar_base revpar_sim delta_revpar_pct delta_revenue_pct delta_price_pct"
    add("revpar_simulation", lambda x: P.revpar_simulation(panel(x)), SIMHIST, r6=sim6)
    add("revpar_simulation_summary", lambda x: P.revpar_simulation_summary(P.revpar_simulation(panel(x))),
        f"""SELECT hotel, season, count(*) AS n, avg(delta_revpar_pct) AS mean_delta_revpar_pct, avg(delta_revenue_pct) AS mean_delta_rev_pct,
        avg(delta_price_pct) AS mean_delta_adr_pct, avg(revpar_base) AS mean_revpar_base, avg(revpar_sim) AS mean_revpar_sim
        FROM ({SIMHIST}) GROUP BY 1, 2""",
        r6="mean_delta_revpar_pct mean_delta_rev_pct mean_delta_adr_pct mean_revpar_base mean_revpar_sim")
    add("whatif_ladder", lambda x: P.whatif_ladder(x.bookings()), LADDER, r6=LADDER6)
    weighted = ", ".join(f"sum({c} * n_stay) / sum(n_stay) AS {c}" for c in ("delta_revpar_pct", "delta_demand_pct", "delta_rev_pct"))
    add("whatif_summary", lambda x: P.whatif_summary(P.whatif_ladder(x.bookings())),
        f"SELECT hotel, shock_pct, {weighted} FROM ({LADDER}) GROUP BY hotel, shock_pct",
        r6="shock_pct delta_revpar_pct delta_demand_pct delta_rev_pct")
    add("risk_slope", lambda x: P.risk_slope(panel(x)), "SELECT * FROM slopes ", r6="risk_slope")
    dual6 = "alpha p0 cancel0 p_star_rev p_star_dual delta_dual_vs_rev_pct risk_revopt risk_dual"
    add("dual_optimize", lambda x: P.dual_optimize(P.with_risk_slope(panel(x))), _dual_sql("pan ", "0.7"), r6=dual6,
        r4="rev_revopt rev_dual")
    busiest = """(SELECT * FROM pan WHERE season = 'Peak' QUALIFY row_number() OVER (PARTITION BY hotel
      ORDER BY demand DESC, year_month DESC) = 1)"""
    add("dual_alpha_sensitivity", lambda x: P.dual_alpha_sensitivity(P.with_risk_slope(panel(x))),
        f"""SELECT hotel, year_month, alpha, p_star_dual, risk_dual AS risk, rev_dual AS rev
        FROM ({_dual_sql(busiest, '0.5, 0.7, 0.9')})""", r6="alpha p_star_dual risk", r4="rev")
    bt6 = """rule_mult adr_base adr_rule revpar_base revpar_rule delta_revpar_pct cancel_base cancel_rule delta_cancel_pp
      delta_rev_pct"""
    add("backtest_rules", _backtest, BACKTEST, r6=bt6)
    win = "avg(CASE WHEN delta_revpar_pct > 1e-9 THEN 1.0 ELSE 0.0 END) AS win_rate"
    add("backtest_summary", lambda x: P.backtest_summary(_backtest(x)),
        f"""SELECT hotel, season, count(*) AS n, avg(delta_revpar_pct) AS mean_delta_revpar, avg(delta_rev_pct) AS mean_delta_rev,
        avg(delta_cancel_pp) AS mean_delta_cancel_pp, {win} FROM ({BACKTEST}) GROUP BY 1, 2""",
        r6="mean_delta_revpar mean_delta_rev mean_delta_cancel_pp win_rate")
    add("go_nogo_gates", lambda x: P.go_nogo_gates(_backtest(x)),
        f"""SELECT *, least(pass_revpar, pass_peak_city, pass_cancel) AS go FROM (SELECT *,
        CASE WHEN mean_delta_revpar_all >= -1e-9 THEN 1 ELSE 0 END AS pass_revpar,
        CASE WHEN hotel <> 'City Hotel' OR mean_delta_revpar_peak >= -1e-9 THEN 1 ELSE 0 END AS pass_peak_city,
        CASE WHEN mean_delta_cancel_pp <= 1.0 THEN 1 ELSE 0 END AS pass_cancel FROM (
        SELECT hotel, avg(delta_revpar_pct) AS mean_delta_revpar_all, avg(delta_revpar_pct) FILTER (season = 'Peak')
        AS mean_delta_revpar_peak, avg(delta_cancel_pp) AS mean_delta_cancel_pp, {win} FROM ({BACKTEST}) GROUP BY hotel))""",
        r6="mean_delta_revpar_all mean_delta_revpar_peak mean_delta_cancel_pp win_rate")
    lags = ", ".join(f"lag({c}, {k}) OVER w AS {c}_lag{k}" for c in LAG_COLS for k in (1, 12))
    names = [f"{c}_lag{k}" for c in LAG_COLS for k in (1, 12)]
    roll = "avg({c}) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS {c}_roll3"
    add("lag_features", lambda x: P.lag_features(panel(x)).select(
            "hotel", "year_month", *names, "adr_roll3", "demand_roll3", "adr_next", "hotel_code"),
        f"""SELECT hotel, year_month, {lags}, {roll.format(c='adr')}, {roll.format(c='demand')}, lead(adr) OVER w AS adr_next,
        CASE WHEN hotel = 'Resort Hotel' THEN 1 ELSE 0 END AS hotel_code FROM pan
        WINDOW w AS (PARTITION BY hotel ORDER BY year_month)""",
        r6=" ".join(n for n in names if not n.startswith("demand")) + " adr_roll3 demand_roll3 adr_next")
    add("stance_labels_hist", lambda x: P.stance_labels_hist(panel(x)).select(
            "hotel", "year_month", "demand", "pressure_hist", "stance_hist"),
        """SELECT *, CASE WHEN pressure_hist <= 0.9 THEN 'STIMULATE' WHEN pressure_hist <= 1.1 THEN 'NEUTRAL' ELSE 'PROTECT' END
        AS stance_hist FROM (SELECT hotel, year_month, demand, 0.5 * avg(demand) OVER (PARTITION BY hotel, month_number)
        / avg(demand) OVER (PARTITION BY hotel) + 0.5 * (demand / avg(demand) OVER (PARTITION BY hotel)) AS pressure_hist FROM pan )""",
        r6="pressure_hist")
    vote = "(CASE WHEN {} THEN 1 WHEN {} THEN -1 ELSE 0 END)"
    votes = [vote.format("ml_adr > fc_adr * 1.03", "ml_adr < fc_adr * 0.97"), vote.format("action = 'RAISE'", "action = 'CUT'"),
             vote.format("0.5 * pressure_adr + 0.5 * pressure_revpar >= 1.1", "0.5 * pressure_adr + 0.5 * pressure_revpar <= 0.9")]
    ups = " + ".join(f"CAST({v} = 1 AS INTEGER)" for v in votes)
    downs = " + ".join(f"CAST({v} = -1 AS INTEGER)" for v in votes)
    add("rate_ensemble", _ensemble,
        f"""SELECT *, 0.85 * bar_recommend AS bar_floor, 1.15 * bar_recommend AS bar_ceil FROM (
        SELECT hotel, year_month, fc_adr, ml_adr, p_star, action, list_sort([fc_adr, ml_adr, p_star])[2] AS bar_recommend,
        CASE WHEN {ups} >= 2 THEN 'RAISE' WHEN {downs} >= 2 THEN 'CUT' ELSE 'HOLD' END AS final_action
        FROM (SELECT *, fc_adr * (1 + 0.06 * (month_number % 3 - 1)) AS ml_adr FROM ({PLAN})))""",
        r6="fc_adr ml_adr p_star bar_recommend bar_floor bar_ceil")
