"""Catalog entries: RevPAR comparison, time intelligence, daily quadrants, room roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgemetrics.functions.bands import RATING_BANDS, RATING_LABELS
from lodgemetrics.operators import kpi as K
from lodgemetrics.operators import revpar as R
from lodgemetrics.plans.bridge_sql import season_of
from lodgemetrics.plans.catalog import Catalog
from lodgemetrics.plans.kpi_queries import RATES, WEIGHTED

MEASURES = {
    "total_bookings": "CAST(sum(tb) AS DOUBLE)", "total_revenue": "sum(rev)", "adr": "sum(adr_w) / nullif(sum(sb), 0)",
    "occupancy_rate": "sum(occ_w) / nullif(sum(tb), 0)", "revpar": "sum(rp_w) / nullif(sum(tb), 0)",
    "cancel_rate": "sum(cb) / nullif(sum(tb), 0)", "no_show_rate": "sum(ns) / nullif(sum(tb), 0)",
    "canceled_bookings": "CAST(sum(cb) AS DOUBLE)", "no_show_bookings": "CAST(sum(ns) AS DOUBLE)",
    "lost_revenue": "sum(rev) * (sum(cb) / sum(tb)) / greatest(1 - sum(cb) / sum(tb), 0.01) * 0.35",
}


def _roles_sql(role_case: str, roles: list[str], by: str = "") -> str:
    """Measures per role, one row per measure, from a panel tagged with ``role``."""
    comma = f"{by}, " if by else ""
    parts = []
    for m, expr in MEASURES.items():
        parts.append(f"SELECT {comma}role, '{m}' AS measure, {expr} AS value FROM tagged WHERE role IS NOT NULL "
                     f"GROUP BY {comma}role")
    picks = ", ".join(f"max(value) FILTER (role = '{r}') AS {r}" for r in roles)
    return f"""SELECT {comma}measure, {picks} FROM (
      WITH tagged AS (SELECT *, {role_case} AS role FROM (SELECT *, max(year) OVER () AS cy_year,
        max(year * 12 + month_number) OVER () AS last_idx FROM panel ))
      {' UNION ALL '.join(parts)}) GROUP BY {comma}measure"""


CY_PY = _roles_sql("""CASE WHEN year = cy_year THEN 'cy' WHEN year = cy_year - 1 AND month_number IN
  (SELECT month_number FROM panel WHERE year = (SELECT max(year) FROM panel )) THEN 'py' END""", ["cy", "py"])
BY_MONTH = _roles_sql("CASE WHEN year = cy_year THEN 'cy' WHEN year = cy_year - 1 THEN 'py' END",
                      ["cy", "py"], "month_number")
SAME_MONTH = _roles_sql("""CASE last_idx - (year * 12 + month_number) WHEN 0 THEN 'current' WHEN 1 THEN 'pm'
  WHEN 12 THEN 'py' END""", ["current", "pm", "py"])
BRIDGE = """SELECT hotel, year_month, revpar_pm AS revpar_prev, occ_pm * (adr - adr_pm) AS delta_from_adr,
  adr * (occupancy_rate - occ_pm) AS delta_from_occupancy, revpar AS revpar_curr,
  revpar - (revpar_pm + occ_pm * (adr - adr_pm) + adr * (occupancy_rate - occ_pm)) AS residual,
  CASE WHEN abs(occ_pm * (adr - adr_pm)) >= abs(adr * (occupancy_rate - occ_pm)) THEN 'price' ELSE 'occupancy' END AS driver
  FROM (SELECT *, lag(adr) OVER w AS adr_pm, lag(occupancy_rate) OVER w AS occ_pm, lag(revpar) OVER w AS revpar_pm
  FROM mon WINDOW w AS (PARTITION BY hotel ORDER BY year_month)) WHERE adr_pm IS NOT NULL"""
QUADRANT = """SELECT d.hotel, CAST(d.arrival_date AS VARCHAR) AS arrival_date, d.adr, d.occupancy_rate, d.revpar, d.bookings,
  CASE WHEN d.adr >= s.a AND d.occupancy_rate >= s.o THEN 'High ADR + High Occ'
    WHEN d.adr < s.a AND d.occupancy_rate >= s.o THEN 'Low ADR + High Occ'
    WHEN d.adr >= s.a THEN 'High ADR + Low Occ' ELSE 'Low ADR + Low Occ' END AS quadrant
  FROM dly d, (SELECT avg(adr) AS a, avg(occupancy_rate) AS o FROM dly WHERE adr IS NOT NULL) s WHERE d.adr IS NOT NULL"""


def _rating_sql(kpi: str) -> str:
    steps = " ".join(f"WHEN {kpi} >= {b} THEN '{n}'" for b, n in zip(RATING_BANDS[kpi], RATING_LABELS))
    return f"CASE WHEN {kpi} IS NULL THEN NULL {steps} ELSE '{RATING_LABELS[-1]}' END AS {kpi}_rating"


def _points(x):
    out = R.daily_points(x.daily("context"), R.daily_segments(x.bookings()))
    pairs = F.transform(F.map_entries("segments"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.withColumn("segments", F.array_join(pairs, ";"))


def _change(x):
    mom = K.monthly_revenue_mom(x.monthly())
    return R.change_sign_label(mom.select("year_month", (F.col("revenue_mom_pct") / 100).alias("change")), "change")


def _room_sql(role: str) -> str:
    return f"""SELECT {role}_room_type AS room_type, count(*) AS bookings,
      CAST(sum(CASE WHEN is_canceled = 0 THEN total_nights ELSE 0 END) AS BIGINT) AS room_nights_sold,
      sum(revenue) AS revenue, sum(revenue) / nullif(sum(CASE WHEN is_canceled = 0 THEN total_nights END), 0)
      AS revpar_{role} FROM b GROUP BY 1"""


SIDES = " UNION ALL ".join(
    f"""SELECT hotel, arrival_date_year AS year, '{r}' AS side, {r}_room_type AS room_type, count(*) AS bookings,
    sum(revenue) AS revenue, sum(total_nights)::BIGINT AS room_nights, avg(adr) AS avg_adr, avg(revpar) AS avg_revpar,
    coalesce(sum(revenue) / nullif(sum(total_nights), 0), avg(revpar)) AS revpar FROM ctx GROUP BY ALL"""
    for r in ("reserved", "assigned"))


def register(cat: Catalog) -> None:
    add = cat.add
    add("revpar_trend", lambda x: R.revpar_trend(x.monthly()),
        "SELECT hotel, year_month, total_bookings, adr, occupancy_rate, revpar, total_revenue FROM mon ",
        r6="adr occupancy_rate revpar", r4="total_revenue")
    picks = ", ".join(f"max({c}) FILTER (hotel = '{h} Hotel') AS {h.lower()}_{n}"
                      for c, n in (("total_revenue", "revenue"), ("adr", "adr"), ("revpar", "revpar"))
                      for h in ("City", "Resort"))
    add("pivot_hotels", lambda x: R.pivot_hotels(x.monthly()), f"SELECT year_month, {picks} FROM mon GROUP BY year_month",
        r6="city_adr resort_adr city_revpar resort_revpar", r4="city_revenue resort_revenue")
    add("revpar_bridge", lambda x: R.revpar_bridge(x.monthly()), BRIDGE,
        r6="revpar_prev delta_from_adr delta_from_occupancy revpar_curr residual")
    add("revpar_bridge_latest", lambda x: R.revpar_bridge_latest(x.monthly()),
        """WITH t AS (SELECT year_month, sum(adr * successful_bookings) / sum(successful_bookings) AS adr,
          sum(occupancy_rate * total_bookings) / sum(total_bookings) AS occ,
          sum(revpar * total_bookings) / sum(total_bookings) AS rp FROM mon GROUP BY year_month),
        c AS (SELECT * FROM t ORDER BY year_month DESC LIMIT 1),
        p AS (SELECT * FROM t ORDER BY year_month DESC LIMIT 1 OFFSET 1)
        SELECT 1 AS step_order, 'Prev RevPAR' AS step, p.rp AS value FROM p
        UNION ALL SELECT 2, 'Delta ADR', p.occ * (c.adr - p.adr) FROM c, p
        UNION ALL SELECT 3, 'Delta Occupancy', c.adr * (c.occ - p.occ) FROM c, p
        UNION ALL SELECT 4, 'Curr RevPAR', c.rp FROM c
        UNION ALL SELECT 5, 'Residual', c.rp - (p.rp + p.occ * (c.adr - p.adr) + c.adr * (c.occ - p.occ)) FROM c, p""",
        r6="value")
    add("season_heatmap", lambda x: R.season_heatmap(x.monthly(), scaled=True),
        f"""SELECT *, (revpar_wtd - min(revpar_wtd) OVER ()) / (max(revpar_wtd) OVER () - min(revpar_wtd) OVER ()) AS heat
        FROM (SELECT hotel, month_number, {season_of('month_number')} AS season,
        sum(revpar * total_bookings) / sum(total_bookings) AS revpar_wtd FROM mon GROUP BY ALL)""", r6="revpar_wtd heat")
    add("season_playbook", lambda x: R.season_playbook(x.monthly()),
        f"""SELECT hotel, season, {WEIGHTED}, CASE WHEN hotel = 'City Hotel' AND season = 'Peak' THEN 'RAISE'
        WHEN hotel = 'Resort Hotel' AND season = 'Peak' THEN 'HOLD' WHEN hotel = 'Resort Hotel' AND season = 'Low' THEN 'CUT'
        ELSE 'HOLD in band' END AS playbook FROM (SELECT *, {season_of('month_number')} AS season FROM mon )
        GROUP BY hotel, season""", r6=RATES, r4="revenue")
    add("latest_month", lambda x: R.latest_month(x.monthly()),
        """SELECT hotel, year_month, total_bookings, adr, occupancy_rate, revpar, total_revenue FROM mon
        WHERE year_month = (SELECT max(year_month) FROM mon )""", r6="adr occupancy_rate revpar", r4="total_revenue")
    add("yoy", lambda x: R.yoy(x.monthly()),
        """SELECT c.hotel, c.year_month, c.revpar, p.revpar AS revpar_py,
        (c.revpar - p.revpar) * 100.0 / nullif(p.revpar, 0) AS revpar_yoy_pct FROM mon c LEFT JOIN mon p
        ON p.hotel = c.hotel AND p.month_number = c.month_number AND p.year = c.year - 1""",
        r6="revpar revpar_py revpar_yoy_pct")
    add("same_month_py", lambda x: R.same_month_py(x.panel()),
        f"""SELECT *, (current - pm) * 100.0 / nullif(pm, 0) AS mom_pct, (current - py) * 100.0 / nullif(py, 0) AS yoy_pct,
        CASE WHEN measure IN ('occupancy_rate', 'cancel_rate', 'no_show_rate') THEN (current - pm) * 100 END AS mom_delta_pp FROM ({SAME_MONTH})""", r6="mom_pct yoy_pct", r4="current pm py mom_delta_pp")
    add("cy_vs_py", lambda x: R.cy_vs_py(x.panel()),
        f"SELECT *, cy - py AS delta, (cy - py) * 100.0 / nullif(py, 0) AS delta_pct FROM ({CY_PY})",
        r6="delta_pct", r4="cy py delta")
    add("cy_py_by_month", lambda x: R.cy_py_by_month(x.panel()), BY_MONTH, r4="cy py")
    add("kpi_rating", lambda x: R.kpi_rating(x.monthly(), ["hotel", "year_month"]),
        f"""SELECT hotel, year_month, adr, occupancy_rate, revpar, {', '.join(map(_rating_sql, RATING_BANDS))}
        FROM (SELECT hotel, year_month, {WEIGHTED} FROM mon GROUP BY hotel, year_month)""", r6="adr occupancy_rate revpar")
    add("change_sign_label", _change,
        """SELECT year_month, change, CAST(sign(change) AS INTEGER) AS change_sign,
        CASE WHEN change IS NOT NULL THEN CASE WHEN change > 0 THEN '▲' WHEN change < 0 THEN '▼' ELSE '▶' END
          || ' ' || printf('%.1f', round(abs(change) * 100, 1)) || '%' END AS change_label FROM (
        SELECT year_month, (revenue - lag(revenue) OVER w) / nullif(lag(revenue) OVER w, 0) AS change FROM (
          SELECT year_month, sum(total_revenue) AS revenue FROM mon GROUP BY year_month) WINDOW w AS (ORDER BY year_month))""",
        r6="change")
    add("adr_occ_quadrant", lambda x: R.adr_occ_quadrant(x.daily()), QUADRANT, r6="adr occupancy_rate revpar")
    add("quadrant_summary", lambda x: R.quadrant_summary(R.adr_occ_quadrant(x.daily())),
        f"""SELECT hotel, quadrant, count(*) AS days, avg(revpar) AS avg_revpar,
        100.0 * count(*) / sum(count(*)) OVER (PARTITION BY hotel) AS day_share_pct FROM ({QUADRANT}) GROUP BY hotel, quadrant""",
        r6="avg_revpar day_share_pct")
    add("daily_points", _points,
        """SELECT CAST(p.arrival_date AS VARCHAR) AS arrival_date, p.* EXCLUDE (arrival_date), s.segments FROM (
        SELECT arrival_date, year, year_month, sum(adr * bookings) / sum(bookings) AS adr,
          sum(occupancy_rate * bookings) / sum(bookings) AS occupancy_rate, sum(revenue) AS revenue,
          sum(bookings)::BIGINT AS bookings, sum(canceled)::BIGINT AS canceled, sum(room_nights_sold)::BIGINT AS room_nights,
          sum(available_room_nights)::BIGINT AS available_room_nights,
          sum(adr * bookings) / sum(bookings) * (sum(occupancy_rate * bookings) / sum(bookings)) AS revpar,
          sum(canceled) / sum(bookings) AS cancel_rate FROM dctx GROUP BY ALL) p JOIN (
        SELECT arrival_date, string_agg(market_segment || '=' || n, ';' ORDER BY market_segment) AS segments FROM (
          SELECT arrival_date, market_segment, count(*) AS n FROM b GROUP BY ALL) GROUP BY arrival_date) s
        ON p.arrival_date = s.arrival_date""", r6="adr occupancy_rate revpar cancel_rate", r4="revenue")
    for role in ("reserved", "assigned"):
        add(f"revpar_by_room_{role}", lambda x, r=role: R.revpar_by_room(x.bookings(part=True), r), _room_sql(role),
            r6=f"revpar_{role}", r4="revenue")
    add("room_type_both_sides", lambda x: R.room_type_both_sides(x.bookings(part=True)), SIDES,
        r6="avg_adr avg_revpar revpar", r4="revenue")
    add("room_type_grouped", lambda x: R.room_type_grouped(
            R.room_type_both_sides(x.bookings(part=True))),
        f"""SELECT room_type, sum(bookings)::BIGINT AS bookings,
        coalesce(sum(revpar * bookings) FILTER (side = 'reserved') / sum(bookings) FILTER (side = 'reserved'), 0.0) AS reserved,
        coalesce(sum(revpar * bookings) FILTER (side = 'assigned') / sum(bookings) FILTER (side = 'assigned'), 0.0) AS assigned
        FROM ({SIDES}) GROUP BY room_type ORDER BY bookings DESC, room_type LIMIT 8""", r6="reserved assigned")
    add("room_mismatch_rate", lambda x: R.room_mismatch_rate(x.bookings(part=True)),
        """SELECT hotel, count(*) AS bookings, count(*) FILTER (reserved_room_type <> assigned_room_type) AS room_changed,
        avg(CASE WHEN reserved_room_type <> assigned_room_type THEN 1 ELSE 0 END) AS mismatch_rate,
        avg(is_canceled) AS cancel_rate FROM b GROUP BY hotel""", r6="mismatch_rate cancel_rate")
