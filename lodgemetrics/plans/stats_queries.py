"""Catalog entries: statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.operators import stats as T
from lodgemetrics.plans.bridge_sql import LEAD_EDA
from lodgemetrics.plans.catalog import Catalog
from lodgemetrics.plans.tails_sql import chi2_p, fisher_p, normal_p
from lodgemetrics.schema import LEAKAGE_COLUMNS

NUMERIC = ["lead_time", "total_nights", "adr", "previous_cancellations", "total_of_special_requests",
           "is_repeated_guest", "booking_changes", "adults", "revenue"]
CATEGORIES = ["hotel", "market_segment", "distribution_channel", "customer_type", "deposit_type", "is_repeated_guest"]
DEP = "CASE deposit_type WHEN 'No Deposit' THEN 0 WHEN 'Refundable' THEN 1 ELSE 2 END"
LEVELS = {"deposit_type": ["No Deposit", "Non Refund", "Refundable"],
          "market_segment": ["Direct", "Corporate", "Groups", "Offline TA/TO", "Online TA"]}


def _assoc_sql(var: str, expr: str | None = None, by: str = "") -> str:
    """Full-grid chi-square with Yates for 2 x 2, straight from expected counts."""
    k, on = (f"{by}, ", f"r.{by} = c.{by} AND") if by else ("", "")
    pick, join = (f"r.{by}, ", f"AND o.{by} = r.{by}") if by else ("", "")
    return f"""SELECT {k}'{var}' AS variable, CAST(sum(o) AS DOUBLE) AS n, count(DISTINCT x) AS r, count(DISTINCT y) AS k,
      CASE WHEN count(DISTINCT x) = 2 AND count(DISTINCT y) = 2 THEN sum(greatest(abs(o - e) - 0.5, 0) ** 2 / e)
        ELSE sum((o - e) ** 2 / e) END AS chi2, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS dof, min(e) AS min_expected,
      count(*) FILTER (e < 5) AS cells_expected_lt_5 FROM (
      SELECT {pick}r.x, c.y, coalesce(o.o, 0) AS o, r.n * c.n / t.n AS e
      FROM (SELECT {k}CAST({expr or var} AS VARCHAR) AS x, count(*) AS n FROM b GROUP BY ALL) r
      JOIN (SELECT {k}CAST(is_canceled AS VARCHAR) AS y, count(*) AS n FROM b GROUP BY ALL) c ON {on} true
      JOIN (SELECT {k}count(*) AS n FROM b {'GROUP BY ' + by if by else ''}) t ON {f't.{by} = r.{by} AND' if by else ''} true
      LEFT JOIN (SELECT {k}CAST({expr or var} AS VARCHAR) AS x, CAST(is_canceled AS VARCHAR) AS y, count(*) AS o FROM b GROUP BY ALL) o
      ON o.x = r.x AND o.y = c.y {join}) {'GROUP BY ' + by if by else ''}"""


V = "sqrt(chi2 / (n * least(r - 1, k - 1)))"


def _mw_sql(by: str = "", value: str = "lead_time", flag: str = "is_canceled", source: str = "b ") -> str:
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    k = f"{by}, " if by else ""
    tie_part = f"PARTITION BY {k}{value}"
    return f"""SELECT {k}n0, n1, u AS u_stat, (greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5)
      / sqrt(n0 * n1 / 12 * ((n0 + n1 + 1) - ties / ((n0 + n1) * (n0 + n1 - 1)))) AS z_stat, 1 - 2 * u / (n0 * n1) AS rank_biserial
      FROM (SELECT *, r0 - n0 * (n0 + 1) / 2 AS u FROM (SELECT {k}CAST(count(*) FILTER (side = 0) AS DOUBLE) AS n0,
        CAST(count(*) FILTER (side = 1) AS DOUBLE) AS n1, sum(mr) FILTER (side = 0) AS r0,
        sum(c * c - 1) AS ties FROM (SELECT {k}{flag} AS side, CAST(count(*) OVER ({tie_part}) AS DOUBLE) AS c,
        rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({tie_part}) - 1) / 2 AS mr FROM {source}) {group}))"""


WEEKEND = "CASE WHEN day_of_week IN (" + ", ".join(f"'{d}'" for d in bands.WEEKEND_DAYS) + ") THEN 1 ELSE 0 END"


def _encoded(x):
    dep = F.when(F.col("deposit_type") == "No Deposit", 0).when(F.col("deposit_type") == "Refundable", 1).otherwise(2)
    return x.bookings(part=True).withColumn("dep_enc", dep)


def _partial_sql(x: str, y: str, z: str) -> str:
    return f"""SELECT '{x}' AS x, '{y}' AS y, '{z}' AS controls, xy AS pearson,
      (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS partial_corr FROM (SELECT corr({x}, {y}) AS xy, corr({x}, {z}) AS xz,
      corr({y}, {z}) AS yz FROM (SELECT *, {DEP} AS dep_enc FROM b ))"""


def _with_bins(x):
    return x.bookings(part=True).withColumn("lead_time_bin", bands.lead_time_bin("lead_time", "eda"))


Z_SQL = """SELECT a.g AS group_a, b2.g AS group_b, 100.0 * a.c / a.n AS rate_a_pct, 100.0 * b2.c / b2.n AS rate_b_pct,
  (a.c / a.n - b2.c / b2.n) / sqrt((a.c + b2.c) / (a.n + b2.n) * (1 - (a.c + b2.c) / (a.n + b2.n)) * (1 / a.n + 1 / b2.n)) AS z_stat,
  (a.n - a.c) * b2.c / (a.c * (b2.n - b2.c)) AS odds_ratio FROM g a JOIN g b2 ON a.g < b2.g"""


def _median_sql(by: str = "") -> str:
    """Chances of a resample's median by binomial sums over ranks, their difference, and its quantiles."""
    k = f"{by}, " if by else ""
    using = f"USING ({by})" if by else "ON true"

    def log_power(base: str) -> str:
        return f"CASE WHEN {base} > 0 THEN j * ln({base}) + (n - j) * ln(1 - {base}) ELSE -1e6 END"

    def tail(base: str) -> str:
        return f"""CASE WHEN {base} <= 0 THEN 0.0 WHEN {base} >= 1 THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1)
          - lgamma(n - j + 1) + {log_power(f'least({base}, 0.9999999999)')})) FROM (SELECT unnest(range(h, least(n, h + CAST(14 * sqrt(n) AS BIGINT)) + 1)) AS j)) END"""

    return f"""WITH counted AS (SELECT {k}is_canceled AS side, CAST(lead_time AS DOUBLE) AS v, count(*) AS c FROM b GROUP BY ALL),
      ranked AS (SELECT {k}side, v, c, CAST(sum(c) OVER (PARTITION BY {k}side ORDER BY v) AS BIGINT) AS hi,
        CAST(sum(c) OVER (PARTITION BY {k}side) AS BIGINT) AS n FROM counted),
      mid AS (SELECT *, CAST(ceil(n / 2) AS BIGINT) AS h, (hi - c) / n AS p, hi / n AS q FROM ranked
        WHERE hi >= n / 2 - sqrt(19 * n) AND hi - c <= n / 2 + sqrt(19 * n)),
      tails AS (SELECT *, {tail('p')} AS tp, {tail('q')} AS tq, lgamma(n + 1) - lgamma(h + 1) - lgamma(n - h + 1) AS lc,
        h * ln(q) + CASE WHEN p > 0 THEN ln(1 - exp(h * (ln(p) - ln(q)))) ELSE 0 END AS la,
        h * ln(1 - p) + CASE WHEN q < 1 THEN ln(1 - exp(h * (ln(1 - q) - ln(1 - p)))) ELSE 0 END AS lb FROM mid),
      chances AS (
        SELECT {k}side, n, v, tq - tp - CASE WHEN n % 2 = 0 AND q < 1 THEN exp(lc + la + h * ln(1 - q)) ELSE 0 END AS w FROM tails
        UNION ALL SELECT {'x.' + by + ', ' if by else ''}x.side, x.n, (x.v + y.v) / 2, exp(x.lc + x.la + y.lb) FROM tails x JOIN tails y
          ON {f'x.{by} = y.{by} AND' if by else ''} x.side = y.side AND x.v < y.v AND x.n % 2 = 0),
      diffs AS (SELECT {k}x.n AS n0, y.n AS n1, y.v - x.v AS d, sum(x.w * y.w) AS w FROM (SELECT * FROM chances WHERE side = 0) x
        JOIN (SELECT * FROM chances WHERE side = 1) y {using} GROUP BY ALL),
      upto AS (SELECT *, sum(w) OVER ({f'PARTITION BY {by}' if by else ''} ORDER BY d) / sum(w) OVER ({f'PARTITION BY {by}' if by else ''}) AS u FROM diffs)
      SELECT {k}n0, n1, min(d) FILTER (u >= 0.5 - 1e-12) AS median_diff, min(d) FILTER (u >= 0.025 - 1e-12) AS ci_low,
        min(d) FILTER (u >= 0.975 - 1e-12) AS ci_high FROM upto GROUP BY {k}n0, n1"""


def _factor_sql(var: str, expr: str | None = None) -> str:
    """Likelihood ratio of a one-factor logit per hotel, and the deviance of its constant."""
    return f"""SELECT hotel, 2 * sum(o * ln(CAST(o AS DOUBLE) * n / (r * c))) AS g, count(DISTINCT x) - 1 AS dof,
        any_value(dev) AS dev FROM (
      SELECT o.hotel, o.x, o.o, sum(o.o) OVER (PARTITION BY o.hotel, o.x) AS r, sum(o.o) OVER (PARTITION BY o.hotel, o.y) AS c,
        sum(o.o) OVER (PARTITION BY o.hotel) AS n, dev
      FROM (SELECT hotel, CAST({expr or var} AS VARCHAR) AS x, is_canceled AS y, count(*) AS o FROM b GROUP BY ALL) o
      JOIN (SELECT hotel, -2 * (sum(is_canceled) * ln(avg(is_canceled)) + sum(1 - is_canceled) * ln(1 - avg(is_canceled))) AS dev
        FROM b GROUP BY hotel) d USING (hotel)) GROUP BY hotel"""


def _one_factor_logit_sql() -> str:
    return f"""WITH cell AS (SELECT hotel, deposit_type AS x, CAST(sum(is_canceled) AS DOUBLE) AS a, CAST(sum(1 - is_canceled) AS DOUBLE) AS z
        FROM b GROUP BY ALL),
      base AS (SELECT hotel, ln(a / z) AS l, 1 / a + 1 / z AS s FROM cell WHERE x = 'No Deposit'),
      terms AS (SELECT hotel, 'deposit_type=' || x AS term, ln(a / z) - l AS coef, sqrt(1 / a + 1 / z + s) AS std_err
          FROM cell JOIN base USING (hotel) WHERE x <> 'No Deposit'
        UNION ALL SELECT hotel, '(intercept)', l, sqrt(s) FROM base)
      SELECT hotel, term, coef, std_err, coef / std_err AS z, {normal_p('(coef / std_err)')} AS p_value, g AS lr_chi2,
        CAST(dof AS INTEGER) AS lr_df, g / dev AS pseudo_r2, exp(coef) AS odds_ratio, exp(coef - 1.96 * std_err) AS or_ci_low,
        exp(coef + 1.96 * std_err) AS or_ci_high FROM terms JOIN ({_factor_sql('deposit_type')}) USING (hotel)"""


def register(cat: Catalog) -> None:
    add = cat.add
    flags = ", ".join(f"('{c}', corr({c}, is_canceled), {int(c in LEAKAGE_COLUMNS)})" for c in NUMERIC)
    add("pearson_vs", lambda x: T.pearson_vs(x.bookings(), "is_canceled", NUMERIC),
        f"""SELECT variable, pearson, CAST(row_number() OVER (ORDER BY abs(pearson) DESC, variable) AS INTEGER) AS rank, is_leakage
        FROM (SELECT unnest(rows).v AS variable, unnest(rows).c AS pearson, unnest(rows).f AS is_leakage FROM (
        SELECT [{', '.join(f"{{'v': '{c}', 'c': corr({c}, is_canceled), 'f': {int(c in LEAKAGE_COLUMNS)}}}" for c in NUMERIC)}]
        AS rows FROM b ))""", r6="pearson")
    add("corr_matrix", lambda x: T.corr_matrix(x.bookings(), ["is_canceled", *NUMERIC]), " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{c}' AS y, corr({a}, {c}) AS pearson FROM b " for a, c in combinations(["is_canceled", *NUMERIC], 2)),
        r6="pearson")
    ranks = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
    add("spearman_vs", lambda x: T.spearman_vs(x.bookings(), "is_canceled", NUMERIC), " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, corr(rx, ry) AS spearman FROM (SELECT {ranks.format(c=c)} AS rx,
        {ranks.format(c='is_canceled')} AS ry FROM b )""" for c in NUMERIC), r6="spearman")
    add("spearman_lead_adr", lambda x: T.spearman_vs(x.stays(), "adr", ["lead_time"]),
        f"""SELECT 'lead_time' AS variable, corr(rx, ry) AS spearman FROM (SELECT {ranks.format(c='lead_time')} AS rx,
        {ranks.format(c='adr')} AS ry FROM stays )""", r6="spearman")
    add("cramers_v", lambda x: T.cramers_v(x.bookings(part=True), "deposit_type", "is_canceled", ["hotel"]),
        f"SELECT hotel, variable, {V} AS cramers_v FROM ({_assoc_sql('deposit_type', by='hotel')})", r6="cramers_v")
    spread = " UNION ALL ".join(
        f"""SELECT variable, {V} AS cramers_v, (SELECT max(p) - min(p) FROM (SELECT 100.0 * avg(is_canceled) AS p FROM b GROUP BY {c}))
        AS cancel_spread_pp, r AS n_categories FROM ({_assoc_sql(c)})""" for c in CATEGORIES)
    add("cramers_v_all", lambda x: T.cramers_v_all(x.bookings(part=True), CATEGORIES), spread, r6="cramers_v cancel_spread_pp")
    add("partial_corr", lambda x: T.partial_corr(_encoded(x), "lead_time", "is_canceled", ["dep_enc"]).unionByName(
        T.partial_corr(_encoded(x), "dep_enc", "is_canceled", ["lead_time"])),
        _partial_sql("lead_time", "is_canceled", "dep_enc") + " UNION ALL " + _partial_sql("dep_enc", "is_canceled", "lead_time"),
        r6="pearson partial_corr")
    tested = ["deposit_type", "market_segment", "hotel"]
    add("chi_square_test", lambda x: T.chi_square_test(x.bookings(part=True), tested, "is_canceled", p_value=False),
        f"SELECT *, {V} AS cramers_v FROM ({' UNION ALL '.join(map(_assoc_sql, tested))})", r6="n chi2 cramers_v min_expected")
    add("chi_square_p_value", lambda x: T.chi_square_test(x.bookings(part=True), tested, "is_canceled"),
        f"SELECT *, {V} AS cramers_v, {chi2_p('chi2', 'dof')} AS p_value FROM ({' UNION ALL '.join(map(_assoc_sql, tested))})",
        r6="n chi2 cramers_v min_expected p_value")
    fisher = """SELECT hotel, CAST(count(*) FILTER (is_repeated_guest = 0 AND is_canceled = 0) AS DOUBLE) AS n00,
      CAST(count(*) FILTER (is_repeated_guest = 0 AND is_canceled = 1) AS DOUBLE) AS n01,
      CAST(count(*) FILTER (is_repeated_guest = 1 AND is_canceled = 0) AS DOUBLE) AS n10,
      CAST(count(*) FILTER (is_repeated_guest = 1 AND is_canceled = 1) AS DOUBLE) AS n11 FROM b GROUP BY hotel"""
    add("fisher_2x2", lambda x: T.fisher_2x2(x.bookings(), "is_repeated_guest", "is_canceled", ["hotel"], p_value=False),
        f"SELECT *, n00 * n11 / (n01 * n10) AS odds_ratio FROM ({fisher})", r6="n00 n01 n10 n11 odds_ratio")
    add("fisher_p_value", lambda x: T.fisher_2x2(x.bookings(), "is_repeated_guest", "is_canceled", ["hotel"]),
        f"SELECT *, n00 * n11 / (n01 * n10) AS odds_ratio, {fisher_p('n00', 'n01', 'n10', 'n11')} AS p_value FROM ({fisher})",
        r6="n00 n01 n10 n11 odds_ratio p_value")
    add("two_prop_ztest_pairwise", lambda x: T.two_prop_ztest_pairwise(x.bookings(part=True), "deposit_type", p_value=False),
        f"""WITH g AS (SELECT deposit_type AS g, CAST(count(*) AS DOUBLE) AS n, CAST(sum(is_canceled) AS DOUBLE) AS c FROM b
        GROUP BY 1) {Z_SQL}""", r6="rate_a_pct rate_b_pct z_stat odds_ratio")
    add("two_prop_ztest_p_value", lambda x: T.two_prop_ztest_pairwise(x.bookings(part=True), "deposit_type"),
        f"""WITH g AS (SELECT deposit_type AS g, CAST(count(*) AS DOUBLE) AS n, CAST(sum(is_canceled) AS DOUBLE) AS c FROM b
        GROUP BY 1), z AS ({Z_SQL.replace('FROM g a', ', a.n - a.c AS wa, a.c AS wb, b2.n - b2.c AS wc, b2.c AS wd FROM g a')}),
        q AS (SELECT *, {normal_p('z_stat')} AS p_value, {fisher_p('wa', 'wb', 'wc', 'wd')} AS fisher_p FROM z)
        SELECT group_a, group_b, rate_a_pct, rate_b_pct, z_stat, odds_ratio, p_value,
        least(p_value * count(*) OVER (), 1.0) AS p_bonferroni, fisher_p FROM q""",
        r6="rate_a_pct rate_b_pct z_stat odds_ratio p_value p_bonferroni fisher_p")
    add("mann_whitney", lambda x: T.mann_whitney(x.bookings(), "lead_time", "is_canceled", p_value=False), _mw_sql(),
        r6="n0 n1 z_stat rank_biserial", r4="u_stat")
    add("mann_whitney_weekend_adr", lambda x: T.mann_whitney(
        x.stays().withColumn("we", bands.is_weekend().cast("int")), "adr", "we", ["hotel"], p_value=False),
        _mw_sql("hotel", "adr", WEEKEND, "stays "), r6="n0 n1 z_stat rank_biserial", r4="u_stat")
    add("welch_t", lambda x: T.welch_t(x.bookings(), "lead_time", "is_canceled", ["hotel"], p_value=False),
        """SELECT hotel, n0, n1, mean0, mean1, (mean1 - mean0) / sqrt(a + c) AS t_stat, (a + c) ** 2 / (a * a / (n0 - 1) + c * c / (n1 - 1))
        AS dof FROM (SELECT *, v0 / n0 AS a, v1 / n1 AS c FROM (SELECT hotel,
        CAST(count(*) FILTER (is_canceled = 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (is_canceled = 1) AS DOUBLE) AS n1,
        avg(lead_time) FILTER (is_canceled = 0) AS mean0, avg(lead_time) FILTER (is_canceled = 1) AS mean1,
        var_samp(lead_time) FILTER (is_canceled = 0) AS v0, var_samp(lead_time) FILTER (is_canceled = 1) AS v1
        FROM b GROUP BY hotel))""", r6="n0 n1 mean0 mean1 t_stat", r4="dof")
    add("welch_t_p_value", lambda x: T.welch_t(x.bookings(), "lead_time", "is_canceled", ["hotel"]))
    add("bootstrap_median_diff", lambda x: T.bootstrap_median_diff(x.bookings(), "lead_time", "is_canceled"), _median_sql(),
        r6="median_diff ci_low ci_high")
    add("bootstrap_median_diff_by_hotel", lambda x: T.bootstrap_median_diff(x.bookings(), "lead_time", "is_canceled", by=["hotel"]),
        _median_sql("hotel"), r6="median_diff ci_low ci_high")
    parts = [f"""SELECT hotel, 'lead_time' AS variable, 'mann_whitney' AS test, u_stat AS statistic, rank_biserial AS effect
      FROM ({_mw_sql('hotel')})"""]
    factors = (("lead_time_bin", LEAD_EDA), ("deposit_type", None), ("market_segment", None))
    for c, e in factors:
        parts.append(f"SELECT hotel, variable, 'chi_square', chi2, {V} FROM ({_assoc_sql(c, e, 'hotel')})")
        parts.append(f"SELECT hotel, '{c}', 'logit', g, g / dev FROM ({_factor_sql(c, e)})")
    tailed = [f"""SELECT hotel, 'lead_time' AS variable, 'mann_whitney' AS test, u_stat AS statistic, rank_biserial AS effect,
      least({normal_p('z_stat')}, 1.0) AS p_value FROM ({_mw_sql('hotel')})"""]
    for c, e in factors:
        tailed.append(f"SELECT hotel, variable, 'chi_square', chi2, {V}, {chi2_p('chi2', 'dof')} FROM ({_assoc_sql(c, e, 'hotel')})")
        tailed.append(f"SELECT hotel, '{c}', 'logit', g, g / dev, {chi2_p('g', 'dof')} FROM ({_factor_sql(c, e)})")
    add("tests_by_hotel", lambda x: T.tests_by_hotel(_with_bins(x), p_value=False), " UNION ALL ".join(parts),
        r6="effect", r4="statistic")
    add("tests_by_hotel_p_value", lambda x: T.tests_by_hotel(_with_bins(x)), " UNION ALL ".join(tailed),
        r6="effect p_value", r4="statistic")
    add("odds_ratio_logit_by_hotel", lambda x: T.odds_ratio_logit(x.bookings(part=True), [], {"deposit_type": LEVELS["deposit_type"]},
                                                                  by=["hotel"]), _one_factor_logit_sql(),
        r6="coef std_err z p_value lr_chi2 pseudo_r2 odds_ratio or_ci_low or_ci_high")
    add("odds_ratio_logit", lambda x: T.odds_ratio_logit(x.bookings(part=True), ["lead_time"], LEVELS))
