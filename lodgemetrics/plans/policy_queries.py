"""Catalog entries: scoring policy and Spark ML models.

Policy operators take any score. They are registered on two scores computed from the booking
itself, so SQL can check them; the model entries train on the bookings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.functions.exprs import bookings
from lodgemetrics.operators import forecast as O
from lodgemetrics.operators import models as M
from lodgemetrics.operators import policy as P
from lodgemetrics.operators import pricing as R
from lodgemetrics.plans.bridge_sql import season_of
from lodgemetrics.plans.catalog import Catalog
from lodgemetrics.plans.tails_sql import mcnemar_p, normal_p

RATES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
  (tp + tn) / (tp + tn + fp + fn) AS accuracy"""
RATES6 = "precision recall f1 accuracy"
BUCKET = """CASE WHEN p < 0.20 THEN 'Low (<0.20)' WHEN p < 0.35 THEN 'Medium (0.20-0.35)' WHEN p < 0.55 THEN 'High (0.35-0.55)'
  ELSE 'Very high (>=0.55)' END"""
TIER = "CASE WHEN p < 0.35 THEN 'Low' WHEN p < 0.55 THEN 'Medium' ELSE 'High' END"
TIES = ["booking_key", "reservation_status", "market_segment"]


def _scored(x, part: bool = False):
    b = x.bookings(part=part)
    k = F.col("booking_key")

    def noise(mul: int, mod: int):
        return ((k * mul) % mod) / F.lit(float(mod))

    lead = F.lit(0.25) * F.col("lead_time") / 366
    return b.withColumns({
        "p": F.lit(0.30) * F.col("is_canceled") + lead + F.lit(0.45) * noise(7919, 10007),
        "p2": F.lit(0.25) * F.col("is_canceled") + lead + F.lit(0.50) * noise(104729, 10009)})


def _confusion(cond: str, key: str = "", source: str = "scored ", group: str = "") -> str:
    return f"""SELECT *, {RATES} FROM (SELECT {key} count(*) FILTER (NOT ({cond}) AND is_canceled = 0) AS tn,
      count(*) FILTER (({cond}) AND is_canceled = 0) AS fp, count(*) FILTER (NOT ({cond}) AND is_canceled = 1) AS fn,
      count(*) FILTER (({cond}) AND is_canceled = 1) AS tp FROM {source} {group})"""


GRID1 = "(SELECT i / 100::DOUBLE AS t1, i / 100::DOUBLE AS t2 FROM generate_series(28, 55) g(i))"
GRID2 = """(SELECT i / 100::DOUBLE AS t1, j / 100::DOUBLE AS t2 FROM generate_series(28, 54, 2) g(i), generate_series(28, 54, 2) h(j))"""
SWEEP = {
    "global": _confusion("p >= t1", "'global' AS rule, t1, t2,", f"scored , {GRID1}", "GROUP BY t1, t2"),
    "dual_and": _confusion("p >= t1 AND p2 >= t2", "'dual_and' AS rule, t1, t2,", f"scored , {GRID2}", "GROUP BY t1, t2"),
    "segment": _confusion("p >= CASE WHEN market_segment = 'Online TA' THEN t1 ELSE t2 END", "'segment' AS rule, t1, t2,",
                          f"scored , {GRID2}", "GROUP BY t1, t2"),
}
AUC = """SELECT {k}n1 AS positives, n0 AS negatives, (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) AS roc_auc FROM (
  SELECT {k}count(*) FILTER (is_canceled = 1) AS n1, count(*) FILTER (is_canceled = 0) AS n0, sum(mr) FILTER (is_canceled = 1) AS r1
  FROM (SELECT {k}is_canceled, rank() OVER ({w} ORDER BY p) + (count(*) OVER (PARTITION BY {k}p) - 1) / 2 AS mr FROM scored ) {g})"""


def _features(x):
    return M.booking_features(x.bookings(part=True, nation=True), ["booking_key"])


def _split(x):
    return M.stratified_split(M.cut_lineage(_features(x)), key=["booking_key", "lead_time", "price_per_person", "total_nights"])


def _train_test(x):
    rows = _split(x)
    return rows.where("is_test = 0").drop("is_test"), rows.where("is_test = 1").drop("is_test")


def _evaluated(x, fit):
    train, test = _train_test(x)
    scored = M.predict(fit(train), test, weight="n")
    return P.confusion_at(scored, 0.35, weight="n").withColumn("k", F.lit(1)).join(
        P.roc_auc(scored, weight="n").withColumn("k", F.lit(1)), "k").drop("k")


def _fit_totals(x):
    """What SQL can state of a fitted forest: scored rows by class, and importances that add up to 1."""
    train, test = _train_test(x)
    model = M.fit_rf(train)
    scored = P.confusion_at(M.predict(model, test, weight="n"), 0.35, weight="n").select(
        (F.col("tn") + F.col("fp")).alias("negatives"), (F.col("fn") + F.col("tp")).alias("positives"))
    parts = M.feature_importance(model, x.spark).agg(F.count(F.lit(1)).alias("variables"), F.sum("importance").alias("importance"))
    return scored.withColumn("k", F.lit(1)).join(parts.withColumn("k", F.lit(1)), "k").drop("k")


def _calibrated(x):
    train, test = _train_test(x)
    model = M.fit_rf(train)
    scored = M.calibrate_isotonic(M.predict(model, train, weight="n"), M.predict(model, test, weight="n"), weight="n")
    return P.calibration_table(scored, "p_cal", weight="n")


def _importance(x):
    train, _ = _train_test(x)
    return M.feature_importance(M.fit_rf(train), x.spark)


def _tuned(x):
    train, _ = _train_test(x)
    return M.tune_cv(train)[1]


def _rate_features(x):
    return R.stance_labels_hist(R.lag_features(M.cut_lineage(R.monthly_panel(x.bookings()))))


def _rate_model(x):
    # months are few and read by every step; left lazy, each reading joins all bookings again
    series = M.cut_lineage(O.monthly_series(x.bookings(), metrics=["demand", "adr", "revpar"]))
    bundle = O.forecast_bundle(series, O.seasonal_naive(series))
    return M.rate_model(_rate_features(x), bundle).select(
        "hotel", "year_month", "fc_adr", "ml_adr_raw", "ml_adr_adj", "ml_pct_vs_season", "ml_adr", "ml_stance")


def register(cat: Catalog) -> None:
    add = cat.add
    add("score_bookings", lambda x: P.score_bookings(_scored(x)).select(
            "booking_key", "p", "predicted_cancel", "is_canceled", "risk_bucket", "risk_tier"),
        f"""SELECT booking_key, p, CASE WHEN p >= 0.35 THEN 1 ELSE 0 END AS predicted_cancel, is_canceled, {BUCKET} AS risk_bucket,
        {TIER} AS risk_tier FROM scored """, r6="p")
    add("confusion_at", lambda x: P.confusion_at(_scored(x), 0.35, by=["hotel"]),
        _confusion("p >= 0.35::DOUBLE", "hotel,", group="GROUP BY hotel"), r6=RATES6)
    add("roc_auc", lambda x: P.roc_auc(_scored(x)), AUC.format(k="", w="", g=""), r6="roc_auc")
    add("roc_auc_by_segment", lambda x: P.roc_auc(_scored(x), by=["market_segment"]),
        AUC.format(k="market_segment, ", w="PARTITION BY market_segment", g="GROUP BY market_segment"), r6="roc_auc")
    for rule, sql in SWEEP.items():
        add(f"threshold_sweep_{rule}", lambda x, r=rule: P.threshold_sweep(_scored(x), r), sql, r6=f"t1 t2 {RATES6}")
    def sweeps(x):
        return P.threshold_sweep(_scored(x)).unionByName(P.threshold_sweep(_scored(x), "dual_and")).unionByName(
            P.threshold_sweep(_scored(x), "segment"))

    add("pick_policy_overall", lambda x: P.pick_policy(sweeps(x), by=()),
        f"""SELECT * FROM ({' UNION ALL '.join(SWEEP.values())}) WHERE recall >= 0.85
        QUALIFY row_number() OVER (ORDER BY fp, precision DESC, recall DESC, t1, t2, rule) = 1""", r6=f"t1 t2 {RATES6}")
    add("pick_policy", lambda x: P.pick_policy(sweeps(x)),
        f"""SELECT * FROM ({' UNION ALL '.join(SWEEP.values())}) WHERE recall >= 0.85
        QUALIFY row_number() OVER (PARTITION BY rule ORDER BY fp, precision DESC, recall DESC, t1, t2, rule) = 1""", r6=f"t1 t2 {RATES6}")
    cols = ["deposit_type", "market_segment", "distribution_channel", "customer_type", "hotel"]
    add("score_by_variable", lambda x: P.score_by_variable(_scored(x, part=True), cols),
        "SELECT *, CAST(row_number() OVER (PARTITION BY variable ORDER BY mean_p DESC, category) AS INTEGER) AS rank FROM ("
        + " UNION ALL ".join(f"""SELECT '{c}' AS variable, {c} AS category, count(*) AS n, avg(p) AS mean_p,
        100.0 * avg(is_canceled) AS actual_cancel_pct, 100.0 * avg(CASE WHEN p >= 0.35::DOUBLE THEN 1 ELSE 0 END) AS predicted_cancel_pct
        FROM scored GROUP BY {c}""" for c in cols) + ")", r6="mean_p actual_cancel_pct predicted_cancel_pct")
    add("calibration_table", lambda x: P.calibration_table(_scored(x)),
        """SELECT least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, count(*) AS bookings, avg(p) AS mean_p, avg(is_canceled) AS cancel_rate,
        avg(p) - avg(is_canceled) AS gap FROM scored GROUP BY 1""", r6="mean_p cancel_rate gap")
    for name, expr, label in (("risk_tier", TIER, bands.risk_tier), ("risk_bucket", BUCKET, bands.risk_bucket)):
        add(name, lambda x, f=label, n=name: P.risk_summary(_scored(x), f("p"), n),
            f"SELECT {expr} AS {name}, count(*) AS bookings, avg(p) AS mean_p, avg(is_canceled) AS cancel_rate FROM scored GROUP BY 1",
            r6="mean_p cancel_rate")
    compared = """SELECT n01, n10, greatest(abs(n01 - n10) - 1, 0) ** 2 / (n01 + n10) AS mcnemar_chi2, n_negatives, fa / n_negatives AS fpr_a,
        fb / n_negatives AS fpr_b, (fb / n_negatives - fa / n_negatives) / sqrt((fa + fb) / (2 * n_negatives)
        * (1 - (fa + fb) / (2 * n_negatives)) * 2 / n_negatives) AS fpr_z FROM (SELECT
        CAST(count(*) FILTER (CAST(p2 >= 0.35::DOUBLE AS INT) <> is_canceled AND CAST(p >= 0.35::DOUBLE AS INT) = is_canceled) AS DOUBLE) AS n01,
        CAST(count(*) FILTER (CAST(p2 >= 0.35::DOUBLE AS INT) = is_canceled AND CAST(p >= 0.35::DOUBLE AS INT) <> is_canceled) AS DOUBLE) AS n10,
        CAST(count(*) FILTER (is_canceled = 0) AS DOUBLE) AS n_negatives,
        CAST(count(*) FILTER (is_canceled = 0 AND p2 >= 0.35::DOUBLE) AS DOUBLE) AS fa,
        CAST(count(*) FILTER (is_canceled = 0 AND p >= 0.35::DOUBLE) AS DOUBLE) AS fb FROM scored )"""
    add("model_compare", lambda x: P.model_compare(_scored(x), "p2", 0.35, "p", 0.35, p_value=False), compared,
        r6="n01 n10 n_negatives mcnemar_chi2 fpr_a fpr_b fpr_z")
    add("model_compare_p_value", lambda x: P.model_compare(_scored(x), "p2", 0.35, "p", 0.35),
        f"SELECT *, {mcnemar_p('n01', 'n10')} AS mcnemar_p, {normal_p('fpr_z')} AS fpr_p FROM ({compared})",
        r6="n01 n10 n_negatives mcnemar_chi2 fpr_a fpr_b fpr_z mcnemar_p fpr_p")
    add("bootstrap_delta_auc", lambda x: P.bootstrap_delta_auc(_scored(x), "p2", "p"))
    for by in ("market_segment", "hotel"):
        add(f"overbooking_buffer_{by}", lambda x, c=by: P.overbooking_buffer(x.bookings(), c),
            f"""SELECT *, least(cancel_rate * 0.6, cap) AS buffer, CASE WHEN cancel_rate * 0.6 > cap THEN 1 ELSE 0 END AS is_capped
            FROM (SELECT {by}, {season_of('arrival_month_number')} AS season, count(*) AS bookings, avg(is_canceled) AS cancel_rate,
            CASE WHEN {by} = 'Groups' THEN 0.15 ELSE 0.20 END AS cap FROM b GROUP BY 1, 2)""".replace("SELECT *, least", "SELECT * EXCLUDE (cap), least", 1),
            r6="cancel_rate buffer")
    add("walk_order", lambda x: P.walk_order(x.bookings().where("is_canceled = 0"), TIES).select(
            "hotel", "arrival_date", "booking_key", "adr", "is_repeated_guest", "walk_rank"),
        f"""SELECT hotel, CAST(arrival_date AS VARCHAR) AS arrival_date, booking_key, adr, is_repeated_guest,
        row_number() OVER (PARTITION BY hotel, arrival_date ORDER BY adr, is_repeated_guest, previous_bookings_not_canceled,
        lead_time, {', '.join(TIES)}) AS walk_rank FROM b WHERE is_canceled = 0""", r6="adr")
    # --- features and models
    add("booking_features", lambda x: _features(x),
        """SELECT booking_key, deposit_type, market_segment, coalesce(country, 'Unknown') AS country, distribution_channel, customer_type,
        hotel, CASE WHEN arrival_month_number IN (12, 1, 2) THEN 'Winter' WHEN arrival_month_number <= 5 THEN 'Spring'
          WHEN arrival_month_number <= 8 THEN 'Summer' ELSE 'Autumn' END AS arrival_season, lead_time, total_of_special_requests,
        guests AS total_guests, adr / guests AS price_per_person,
        CASE WHEN coalesce(children, 0) > 0 OR babies > 0 THEN 1 ELSE 0 END AS is_family, total_nights,
        lead_time / greatest(total_nights, 1) AS lead_time_per_night,
        coalesce(previous_cancellations / nullif(previous_cancellations + previous_bookings_not_canceled, 0), 0.0) AS history_cancel_rate,
        CASE WHEN stays_in_weekend_nights > 0 AND stays_in_week_nights = 0 THEN 1 ELSE 0 END AS is_weekend_only,
        arrival_month_number AS arrival_month_mapped, is_canceled FROM (SELECT *,
          greatest(adults + coalesce(children, 0) + babies, 1) AS guests FROM b )""",
        r6="""lead_time total_of_special_requests total_guests price_per_person is_family total_nights lead_time_per_night
        history_cancel_rate is_weekend_only arrival_month_mapped""")
    add("stratified_split", lambda x: _split(x).groupBy("is_canceled").agg(
            bookings(), F.sum("is_test").alias("test_rows")),
        """SELECT is_canceled, count(*) AS bookings, CAST(floor((count(*) - 1) * 0.2) + 1 AS BIGINT) AS test_rows FROM b GROUP BY 1""")
    add("fit_rf", lambda x: _evaluated(x, M.fit_rf))
    held = "CAST(floor((count(*) FILTER (is_canceled = {c}) - 1) * 0.2) + 1 AS BIGINT)"
    add("fit_rf_totals", _fit_totals,
        f"SELECT {held.format(c=0)} AS negatives, {held.format(c=1)} AS positives, CAST(17 AS BIGINT) AS variables, 1.0 AS importance FROM b ",
        r6="importance")
    add("fit_gbt", lambda x: _evaluated(x, M.fit_gbt))
    add("tune_cv", _tuned)
    add("calibrate_isotonic", _calibrated)
    add("feature_importance", _importance)
    add("rate_model", _rate_model)
    add("rate_model_cv", lambda x: M.rate_model_cv(_rate_features(x)))
