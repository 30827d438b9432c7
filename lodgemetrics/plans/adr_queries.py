"""Catalog entries: rate strategy."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.operators import adr as A
from lodgemetrics.plans.bridge_sql import LEAD_STRATEGY
from lodgemetrics.plans.catalog import Catalog
from lodgemetrics.schema import DAY_NAMES

STATS = """count(*) AS n, avg(adr) AS mean, stddev_samp(adr) AS std, min(adr) AS min, max(adr) AS max,
  quantile_cont(adr, 0.5) AS median, quantile_cont(adr, 0.25) AS p25, quantile_cont(adr, 0.75) AS p75"""
STATS6 = "mean std min max median p25 p75"
WE = "day_of_week IN ('Friday', 'Saturday', 'Sunday')"
PREMIUM = f"""SELECT *, weekend_mean - weekday_mean AS premium, weekend_median - weekday_median AS premium_median,
  100.0 * (weekend_mean - weekday_mean) / weekday_mean AS premium_pct FROM (SELECT {{keys}}
  count(*) FILTER ({WE}) AS n_weekend, count(*) FILTER (NOT {WE}) AS n_weekday, avg(adr) FILTER ({WE}) AS weekend_mean,
  avg(adr) FILTER (NOT {WE}) AS weekday_mean, quantile_cont(adr, 0.5) FILTER ({WE}) AS weekend_median,
  quantile_cont(adr, 0.5) FILTER (NOT {WE}) AS weekday_median FROM stays {{group}})"""
PREMIUM6 = "weekend_mean weekday_mean weekend_median weekday_median premium premium_median premium_pct"
ROOMS = list("ABCDEFGHI")
WINDOW_SEASON = """CASE WHEN arrival_month_number IN (7, 8) THEN 'Peak (Jul-Aug)'
  WHEN arrival_month_number IN (1, 2, 11) THEN 'Low (Jan/Feb/Nov)' ELSE 'Shoulder' END"""


def _ladder_sql(hotel: bool) -> str:
    k, part = ("hotel, ", "PARTITION BY hotel") if hotel else ("", "")
    on = "r.hotel = a.hotel AND " if hotel else ""
    key = "coalesce(r.hotel, a.hotel) AS hotel, " if hotel else ""
    return f"""SELECT *, CAST(row_number() OVER ({part} ORDER BY median_adr, room_type) AS INTEGER) AS rank,
      coalesce(median_adr - lag(median_adr) OVER ({part} ORDER BY median_adr, room_type), 0.0) AS premium_vs_prev,
      CASE WHEN bookings_reserved > 0 AND row_number() OVER ({part} ORDER BY bookings_reserved > 0 DESC, median_adr, room_type)
        <= 2 THEN 1 ELSE 0 END AS is_cheap
      FROM (SELECT {key}coalesce(r.t, a.t) AS room_type, coalesce(r.m, a.m) AS median_adr, coalesce(r.n, 0) AS bookings_reserved
        FROM (SELECT {k}reserved_room_type AS t, quantile_cont(adr, 0.5) AS m, count(*) AS n FROM stays GROUP BY ALL) r
        FULL JOIN (SELECT {k}assigned_room_type AS t, quantile_cont(adr, 0.5) AS m FROM stays GROUP BY ALL) a
        ON {on}r.t = a.t)"""


def _pairs_sql(hotel: bool, ties: str) -> str:
    h = "AND l1.hotel = s.hotel" if hotel else ""
    return f"""SELECT s.*, l1.median_adr AS r_med, l2.median_adr AS a_med, l2.median_adr - l1.median_adr AS premium_gap,
      l2.rank - l1.rank AS rank_delta, CASE WHEN s.reserved_room_type = s.assigned_room_type THEN 'match'
      WHEN l2.median_adr > l1.median_adr THEN 'upgrade' WHEN l2.median_adr < l1.median_adr THEN 'downgrade' ELSE '{ties}' END
      AS shift_type, CASE WHEN l1.is_cheap = 1 AND l2.median_adr > l1.median_adr AND s.reserved_room_type <> s.assigned_room_type
      THEN 1 ELSE 0 END AS free_upgrade
      FROM stays s JOIN ({_ladder_sql(hotel)}) l1 ON l1.room_type = s.reserved_room_type {h}
      JOIN ({_ladder_sql(hotel)}) l2 ON l2.room_type = s.assigned_room_type {h.replace('l1', 'l2')}"""


UPSELL = """count(*) AS n_stay, avg(CASE WHEN shift_type <> 'match' THEN 1 ELSE 0 END) AS mismatch_rate,
  count(*) FILTER (shift_type = 'upgrade') / count(*) FILTER (shift_type <> 'match') AS upgrade_share,
  CAST(sum(free_upgrade) AS BIGINT) AS free_upgrades,
  coalesce(sum(premium_gap * total_nights) FILTER (free_upgrade = 1), 0.0) AS upsell_opp,
  coalesce(avg(premium_gap) FILTER (free_upgrade = 1), 0.0) AS mean_free_premium,
  avg(adr) FILTER (shift_type = 'match') AS adr_match, avg(adr) FILTER (shift_type <> 'match') AS adr_mismatch"""
SCORE = {
    "mean_adr": "SELECT hotel, avg(adr) AS v FROM stays GROUP BY hotel",
    "median_adr": "SELECT hotel, quantile_cont(adr, 0.5) AS v FROM stays GROUP BY hotel",
    "weekend_premium": f"SELECT hotel, avg(adr) FILTER ({WE}) - avg(adr) FILTER (NOT {WE}) AS v FROM stays GROUP BY hotel",
    "season_spread": """SELECT hotel, max(m) / min(m) - 1 AS v FROM (SELECT hotel, arrival_month_number, avg(adr) AS m
      FROM stays GROUP BY 1, 2) GROUP BY hotel""",
    "last_min_vs_early_gap": """SELECT hotel, quantile_cont(adr, 0.5) FILTER (lead_time <= 7)
      - quantile_cont(adr, 0.5) FILTER (lead_time > 180) AS v FROM stays GROUP BY hotel""",
    "mismatch_rate_pct": """SELECT hotel, 100.0 * avg(CASE WHEN reserved_room_type <> assigned_room_type THEN 1 ELSE 0 END) AS v
      FROM stays GROUP BY hotel""",
    "upsell_opp_k": f"SELECT hotel, upsell_opp / 1000 AS v FROM (SELECT hotel, {UPSELL} FROM ({_pairs_sql(True, 'downgrade')}) GROUP BY hotel)",
}


def _pairs(x, hotel: bool = False, ties: str = "lateral"):
    by = ["hotel"] if hotel else []
    return A.room_pairs(_counts(x, hotel), by, ties)


def _counts(x, hotel: bool = False):
    return A.room_counts(x.stays(part=True), ["hotel"] if hotel else [])


def register(cat: Catalog) -> None:
    add = cat.add
    groups = {
        "month": ["hotel", "arrival_month_number"], "weekday": ["day_of_week"], "room": ["reserved_room_type"],
        "customer_type": ["hotel", "customer_type"], "hotel": ["hotel"], "segment": ["market_segment"],
    }
    for name, dims in groups.items():
        add(f"adr_stats_by_{name}", lambda x, d=dims: A.adr_stats_by(x.stays(part="reserved_room_type" in d), d),
            f"SELECT {', '.join(dims)}, {STATS} FROM stays GROUP BY {', '.join(dims)}", r6=STATS6)
    add("adr_stats_by_room_match", lambda x: A.adr_stats_by(
            x.stays(part=True).withColumn("room_match", 1 - bands.room_mismatch_flag()), ["room_match"]),
        f"""SELECT CASE WHEN reserved_room_type = assigned_room_type THEN 1 ELSE 0 END AS room_match, {STATS}
        FROM stays GROUP BY 1""", r6=STATS6)
    add("season_adr_index", lambda x: A.season_adr_index(x.stays()),
        """SELECT arrival_month_number, count(*) AS n, avg(adr) AS mean, stddev_samp(adr) AS std, min(adr) AS min,
        max(adr) AS max, quantile_cont(adr, 0.5) AS median, avg(adr) / (SELECT avg(adr) FROM stays ) AS season_index
        FROM stays GROUP BY 1""", r6="mean std min max median season_index")
    years = list(range(1995, 2002))
    picks = ", ".join(f"avg(adr) FILTER (arrival_date_year = {y}) AS \"{y}\"" for y in years)
    picks += f", avg(adr) FILTER (arrival_date_year IS NULL OR arrival_date_year NOT IN ({', '.join(map(str, years))})) AS other"
    add("adr_grid_month_year", lambda x: A.adr_grid(x.stays(), "arrival_month_number", "arrival_date_year", years)
        .withColumnsRenamed({str(y): f"y{y}" for y in years}),
        f"SELECT arrival_month_number, {picks} FROM stays GROUP BY 1".replace('"1', 'y1').replace('"2', 'y2').replace('"', ''),
        r6=" ".join(f"y{y}" for y in years) + " other")
    picks = ", ".join(f"avg(adr) FILTER (day_of_week = '{d}') AS {d}" for d in DAY_NAMES)
    picks += f", avg(adr) FILTER (day_of_week IS NULL OR day_of_week NOT IN ({', '.join(repr(d) for d in DAY_NAMES)})) AS other"
    add("adr_grid_month_weekday", lambda x: A.adr_grid(x.stays(), "arrival_month_number", "day_of_week", DAY_NAMES),
        f"SELECT arrival_month_number, {picks} FROM stays GROUP BY 1", r6=" ".join(DAY_NAMES) + " other")
    months = list(range(1, 13))
    picks = ", ".join(f"quantile_cont(adr, 0.5) FILTER (arrival_month_number = {m}) AS m{m}" for m in months)
    picks += ", quantile_cont(adr, 0.5) FILTER (arrival_month_number IS NULL OR arrival_month_number NOT BETWEEN 1 AND 12) AS other"
    add("adr_grid_lead_month", lambda x: A.adr_grid(
            x.stays().withColumn("lead_bin", bands.lead_time_bin("lead_time", "strategy")), "lead_bin",
            "arrival_month_number", months, "median", ["hotel"]).withColumnsRenamed({str(m): f"m{m}" for m in months}),
        f"SELECT hotel, {LEAD_STRATEGY} AS lead_bin, {picks} FROM stays GROUP BY 1, 2", r6=" ".join(f"m{m}" for m in months) + " other")
    for name, by in (("", []), ("_by_hotel", ["hotel"]), ("_by_month", ["arrival_month_number"])):
        keys = ", ".join(by)
        add(f"weekend_premium{name}", lambda x, b=by: A.weekend_premium(x.stays(), b),
            PREMIUM.format(keys=keys + "," if keys else "", group=f"GROUP BY {keys}" if keys else ""), r6=PREMIUM6)
    add("weekend_premium_by_segment", lambda x: A.weekend_premium(
            x.stays(), ["hotel", "market_segment"], 30, ("market_segment", 200)),
        PREMIUM.format(keys="hotel, market_segment,", group="""GROUP BY hotel, market_segment HAVING count(*) FILTER (day_of_week
        IN ('Friday', 'Saturday', 'Sunday')) >= 30""") + """ WHERE n_weekday >= 30 AND market_segment IN (SELECT market_segment
        FROM stays GROUP BY market_segment HAVING count(*) >= 200)""", r6=PREMIUM6)
    add("lead_bin_adr", lambda x: A.lead_bin_adr(x.stays(), ["hotel"]),
        f"SELECT hotel, {LEAD_STRATEGY} AS lead_bin, {STATS} FROM stays GROUP BY 1, 2", r6=STATS6)
    add("lead_bin_adr_by_season", lambda x: A.lead_bin_adr(
            x.stays().withColumn("season_group", bands.season("arrival_month_number", "window")), ["season_group"]),
        f"SELECT {WINDOW_SEASON} AS season_group, {LEAD_STRATEGY} AS lead_bin, {STATS} FROM stays GROUP BY 1, 2", r6=STATS6)
    add("lead_bin_adr_by_segment", lambda x: A.lead_bin_adr(x.stays(), ["market_segment"]),
        f"SELECT market_segment, {LEAD_STRATEGY} AS lead_bin, {STATS} FROM stays GROUP BY 1, 2", r6=STATS6)
    add("rolling_median_by_lead", lambda x: A.rolling_median_by_lead(x.stays()),
        """WITH d AS (SELECT hotel, lead_time, count(*) AS n FROM stays GROUP BY 1, 2),
        p AS (SELECT hotel, lead_time, (sum(n) OVER (PARTITION BY hotel ORDER BY lead_time) - n / 2)
          / greatest(300, floor(sum(n) OVER (PARTITION BY hotel) / 40)) AS pos FROM d)
        SELECT c.hotel, c.lead_time, count(*) AS window_rows, quantile_cont(s.adr, 0.5) AS rolling_median
        FROM p c JOIN p m ON m.hotel = c.hotel AND m.pos BETWEEN c.pos - 0.5 AND c.pos + 0.5
        JOIN stays s ON s.hotel = m.hotel AND s.lead_time = m.lead_time
        GROUP BY 1, 2 HAVING count(*) >= 80""", r6="rolling_median")
    add("room_price_ladder", lambda x: A.room_price_ladder(A.room_counts(x.stays(part=True))), _ladder_sql(False), r6="median_adr premium_vs_prev")
    add("room_price_ladder_by_hotel", lambda x: A.room_price_ladder(A.room_counts(x.stays(part=True), ["hotel"]), ["hotel"]), _ladder_sql(True),
        r6="median_adr premium_vs_prev")
    for name, hotel, ties in (("", False, "lateral"), ("_by_hotel", True, "downgrade")):
        key = "hotel, " if hotel else ""
        add(f"room_shift_taxonomy{name}",
            lambda x, h=hotel, t=ties: A.room_shift_taxonomy(_pairs(x, h, t), ["hotel"] if h else [], _counts(x, h)),
            f"""SELECT {key}shift_type, count(*) AS bookings, avg(adr) AS mean_adr, quantile_cont(adr, 0.5) AS median_adr, avg(rank_delta) AS mean_rank_delta,
            CAST(sum(free_upgrade) AS BIGINT) AS free_upgrades FROM ({_pairs_sql(hotel, ties)}) WHERE shift_type <> 'match'
            GROUP BY {key}shift_type""", r6="mean_adr median_adr mean_rank_delta")
    add("upsell_kpi", lambda x: A.upsell_kpi(_pairs(x, True, "downgrade"), ["hotel"]),
        f"SELECT hotel, {UPSELL} FROM ({_pairs_sql(True, 'downgrade')}) GROUP BY hotel",
        r6="mismatch_rate upgrade_share mean_free_premium adr_match adr_mismatch", r4="upsell_opp")
    add("upsell_opportunity", lambda x: A.upsell_opportunity(_pairs(x, False, "downgrade"), counts=_counts(x)),
        f"""SELECT reserved_room_type, assigned_room_type, count(*) AS bookings, sum(total_nights)::BIGINT AS nights,
        max(premium_gap) AS mean_premium, max(premium_gap) * sum(total_nights) AS opportunity,
        quantile_cont(adr, 0.5) AS median_adr
        FROM ({_pairs_sql(False, 'downgrade')}) WHERE shift_type = 'upgrade' GROUP BY 1, 2
        ORDER BY bookings DESC, 1, 2 LIMIT 10""", r6="mean_premium median_adr", r4="opportunity")
    picks = ", ".join(f"count(*) FILTER (assigned_room_type = '{r}') AS {r}" for r in ROOMS)
    picks += f", count(*) FILTER (assigned_room_type IS NULL OR assigned_room_type NOT IN ({', '.join(repr(r) for r in ROOMS)})) AS other"
    add("room_transition_matrix", lambda x: A.room_transition_matrix(x.stays(part=True), ROOMS),
        f"SELECT reserved_room_type, {picks} FROM stays GROUP BY 1")
    gap = """avg(is_canceled) AS cancel_rate, avg(adr) FILTER (is_canceled = 0) AS mean_stay,
      avg(adr) FILTER (is_canceled = 1) AS mean_canceled,
      avg(adr) FILTER (is_canceled = 1) - avg(adr) FILTER (is_canceled = 0) AS mean_gap,
      quantile_cont(adr, 0.5) FILTER (is_canceled = 1) - quantile_cont(adr, 0.5) FILTER (is_canceled = 0) AS median_gap"""
    for name, by in (("", ["hotel"]), ("_by_month", ["hotel", "arrival_month_number"])):
        keys = ", ".join(by)
        add(f"cancel_adjusted_adr{name}", lambda x, b=by: A.cancel_adjusted_adr(x.bookings(), b),
            f"SELECT {keys}, {gap} FROM b WHERE adr > 0 GROUP BY {keys}",
            r6="cancel_rate mean_stay mean_canceled mean_gap median_gap")
    for dim, n in (("customer_type", 50), ("deposit_type", 30)):
        add(f"slope_table_{dim}", lambda x, d=dim, k=n: A.slope_table(x.stays(part=d == "deposit_type"), d, k),
            f"""SELECT hotel, {dim}, count(*) AS n, avg(adr) AS mean, quantile_cont(adr, 0.5) AS median FROM stays
            WHERE {dim} IN (SELECT {dim} FROM (SELECT hotel, {dim}, count(*) AS k FROM stays GROUP BY 1, 2)
            GROUP BY {dim} HAVING min(k) >= {n}) GROUP BY 1, 2""", r6="mean median")
    add("kpi_scorecard", lambda x: A.kpi_scorecard(x.stays(part=True)),
        "SELECT hotel, metric, v AS value, CASE WHEN max(v) OVER w = min(v) OVER w THEN 0.5 ELSE (v - min(v) OVER w) "
        "/ (max(v) OVER w - min(v) OVER w) END AS position FROM ("
        + " UNION ALL ".join(f"SELECT hotel, '{m}' AS metric, v FROM ({q})" for m, q in SCORE.items())
        + ") WINDOW w AS (PARTITION BY metric)", r4="value position")
