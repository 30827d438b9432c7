"""Catalog entries: KPI, share and mix queries, and the booking cube."""

from __future__ import annotations

from lodgemetrics.operators import kpi as K
from lodgemetrics.plans.bridge_sql import LEAD_BIN, PAID
from lodgemetrics.plans.catalog import Catalog

WEIGHTED = """sum(total_bookings)::BIGINT AS bookings, sum(total_revenue) AS revenue,
  sum(adr * successful_bookings) / nullif(sum(successful_bookings), 0) AS adr,
  sum(occupancy_rate * total_bookings) / nullif(sum(total_bookings), 0) AS occupancy_rate,
  sum(revpar * total_bookings) / nullif(sum(total_bookings), 0) AS revpar,
  sum(canceled_bookings) / nullif(sum(total_bookings), 0) AS cancel_rate"""
DIRECT = f"""count(*) AS bookings, count(*) FILTER (is_canceled = 0) AS successful_bookings, sum(revenue) AS revenue,
  avg({PAID}) AS adr, avg(1.0 - is_canceled) AS occupancy_rate, avg(is_canceled) AS cancel_rate,
  avg({PAID}) * avg(1.0 - is_canceled) AS revpar"""
SHARE = "100.0 * sum(revenue) / nullif(sum(sum(revenue)) OVER (), 0)"
RATES = "adr occupancy_rate revpar cancel_rate"
CUBE_SUMS = """sum(bookings)::BIGINT AS bookings, sum(canceled)::BIGINT AS canceled, sum(noshow)::BIGINT AS noshow,
  sum(revenue) AS revenue, sum(canceled) / greatest(sum(bookings), 1) AS cancel_rate,
  sum(noshow) / greatest(sum(bookings), 1) AS noshow_rate,
  sum(revenue) * (sum(canceled) / greatest(sum(bookings), 1))
    / greatest(1 - sum(canceled) / greatest(sum(bookings), 1), 0.01) * 0.35 AS lost_est"""
SLICE = dict(hotels=["City Hotel"], years=[1997, 1998], month_from="1997-03", month_to="1998-10",
             filters={"segment": "Online TA"}, brush={"deposit_type": "No Deposit", "month_number": 7})
SLICE_SQL = """SELECT * FROM cube WHERE hotel = 'City Hotel' AND year IN (1997, 1998)
  AND year_month BETWEEN '1997-03' AND '1998-10' AND segment = 'Online TA' AND deposit_type = 'No Deposit'
  AND CAST(substr(year_month, 6, 2) AS INTEGER) = 7"""


def register(cat: Catalog) -> None:
    add = cat.add
    cube = lambda x: K.booking_cube(x.bookings(part=True, nation=True))
    add("kpi_total", lambda x: K.kpi_total(x.monthly()), f"SELECT {WEIGHTED} FROM mon ", r6=RATES, r4="revenue")
    add("kpi_total_direct", lambda x: K.kpi_direct(x.bookings()), f"SELECT {DIRECT} FROM b ",
        r6=RATES, r4="revenue")
    add("weighted_mean", lambda x: K.weighted_mean(x.monthly(), "avg_total_nights", "successful_bookings", ["hotel", "year"]),
        """SELECT hotel, year, coalesce(sum(avg_total_nights * successful_bookings) FILTER (avg_total_nights IS NOT NULL)
        / nullif(sum(successful_bookings) FILTER (avg_total_nights IS NOT NULL), 0), 0.0) AS avg_total_nights_wtd
        FROM mon GROUP BY hotel, year""", r6="avg_total_nights_wtd")
    add("monthly_baseline", lambda x: K.monthly_baseline(x.bookings()),
        f"SELECT year_month, {DIRECT} FROM b GROUP BY year_month", r6=RATES, r4="revenue")
    add("monthly_revenue_mom", lambda x: K.monthly_revenue_mom(x.monthly()),
        """SELECT year_month, bookings, revenue, 100.0 * (revenue - lag(revenue) OVER w) / nullif(lag(revenue) OVER w, 0)
        AS revenue_mom_pct FROM (SELECT year_month, sum(total_bookings)::BIGINT AS bookings, sum(total_revenue) AS revenue
        FROM mon GROUP BY year_month) WINDOW w AS (ORDER BY year_month)""", r6="revenue_mom_pct", r4="revenue")
    add("monthly_trends", lambda x: K.monthly_trends(x.monthly()),
        """SELECT year_month, sum(total_bookings)::BIGINT AS total_bookings, sum(successful_bookings)::BIGINT AS successful_bookings,
        sum(canceled_bookings)::BIGINT AS canceled_bookings, sum(total_revenue) AS total_revenue,
        sum(adr * greatest(successful_bookings, 1)) / sum(greatest(successful_bookings, 1)) AS adr,
        sum(occupancy_rate * total_bookings) / sum(total_bookings) AS occupancy_rate,
        sum(revpar * total_bookings) / sum(total_bookings) AS revpar,
        sum(canceled_bookings) / sum(total_bookings) AS cancel_rate FROM mon GROUP BY year_month""",
        r6=RATES, r4="total_revenue")
    add("revenue_share_by_channel", lambda x: K.revenue_share_by(x.bookings(), "distribution_channel", 35.0),
        f"""SELECT *, CASE WHEN revenue_share_pct >= 35 THEN 'concentration risk' ELSE 'acceptable' END AS insight FROM (
        SELECT distribution_channel, count(*) AS bookings, sum(revenue) AS revenue, {SHARE} AS revenue_share_pct
        FROM b GROUP BY distribution_channel)""", r6="revenue_share_pct", r4="revenue")
    add("segment_mix", lambda x: K.segment_mix(x.bookings()),
        f"""SELECT market_segment, count(*) AS bookings, sum(revenue) AS revenue, avg(is_canceled) AS cancel_rate,
        {SHARE} AS revenue_share_pct FROM b GROUP BY market_segment""", r6="cancel_rate revenue_share_pct", r4="revenue")
    for by in ("revenue", "bookings"):
        add(f"top_countries_by_{by}", lambda x, c=by: K.top_countries(x.bookings(nation=True), 10, c),
            f"""SELECT coalesce(country, '(blank)') AS country_code, count(*) AS bookings, sum(revenue) AS revenue,
            avg(is_canceled) AS cancel_rate, {SHARE} AS revenue_share_pct FROM b GROUP BY 1
            ORDER BY {by} DESC, country_code LIMIT 10""", r6="cancel_rate revenue_share_pct", r4="revenue")
    add("kpi_by_hotel", lambda x: K.kpi_by_hotel(x.monthly()), f"SELECT hotel, {WEIGHTED} FROM mon GROUP BY hotel",
        r6=RATES, r4="revenue")
    add("kpi_by_hotel_direct", lambda x: K.kpi_direct(x.bookings(), ["hotel"]),
        f"SELECT hotel, {DIRECT} FROM b GROUP BY hotel", r6=RATES, r4="revenue")
    add("customer_type_monthly", lambda x: K.customer_type_monthly(x.bookings()),
        """SELECT year_month, customer_type, count(*) AS bookings,
        CAST(sum(CASE WHEN is_canceled = 0 THEN total_nights ELSE 0 END) AS BIGINT) AS room_nights,
        sum(revenue) AS revenue, avg(is_canceled) AS cancel_rate FROM b GROUP BY ALL""", r6="cancel_rate", r4="revenue")
    other = "CASE WHEN customer_type IN ('Transient', 'Transient-Party', 'Contract') THEN customer_type ELSE 'Other' END"
    add("customer_type_topn_other", lambda x: K.customer_type_topn_other(x.bookings()),
        f"""SELECT hotel, arrival_date_year AS year, year_month, {other} AS customer_type, count(*) AS bookings,
        sum(revenue) AS revenue, sum(total_nights)::BIGINT AS room_nights, avg(adr) AS avg_adr FROM b GROUP BY ALL""",
        r6="avg_adr", r4="revenue")
    add("customer_type_series", lambda x: K.customer_type_series(K.customer_type_topn_other(x.bookings()), "room_nights"),
        """SELECT year_month, sum(CASE WHEN customer_type = 'Transient' THEN total_nights ELSE 0 END)::BIGINT AS "Transient",
        sum(CASE WHEN customer_type = 'Transient-Party' THEN total_nights ELSE 0 END)::BIGINT AS "Transient-Party",
        sum(CASE WHEN customer_type = 'Contract' THEN total_nights ELSE 0 END)::BIGINT AS "Contract" FROM b GROUP BY year_month""")
    add("customer_type_share", lambda x: K.customer_type_share(x.bookings()),
        f"""SELECT customer_type, count(*) AS bookings, sum(revenue) AS revenue, avg(is_canceled) AS cancel_rate,
        avg({PAID}) AS adr, {SHARE} AS revenue_share_pct FROM b GROUP BY customer_type""",
        r6="cancel_rate adr revenue_share_pct", r4="revenue")
    add("repeat_vs_new", lambda x: K.repeat_vs_new(x.bookings()),
        """SELECT CASE WHEN is_repeated_guest = 1 THEN 'Repeat' ELSE 'New' END AS guest_type, hotel, count(*) AS bookings,
        avg(is_canceled) AS cancel_rate, sum(revenue) AS revenue FROM b GROUP BY ALL""", r6="cancel_rate", r4="revenue")
    add("special_requests_effect", lambda x: K.special_requests_effect(x.bookings()),
        f"""SELECT CASE WHEN total_of_special_requests <= 2 THEN CAST(total_of_special_requests AS VARCHAR) ELSE '3+' END
        AS special_requests, count(*) AS bookings, avg(is_canceled) AS cancel_rate, avg({PAID}) AS adr FROM b GROUP BY 1""",
        r6="cancel_rate adr")
    add("prev_cancel_effect", lambda x: K.prev_cancel_effect(x.bookings()),
        """SELECT CASE previous_cancellations WHEN 0 THEN 'Never canceled' WHEN 1 THEN 'Canceled once'
        ELSE 'Canceled 2+ times' END AS prev_cancel_band, count(*) AS bookings, avg(is_canceled) AS cancel_rate
        FROM b GROUP BY 1""", r6="cancel_rate")
    add("direct_vs_nondirect", lambda x: K.direct_vs_nondirect(x.bookings()),
        f"""SELECT hotel, CASE WHEN distribution_channel = 'Direct' THEN 'Direct' ELSE 'Non-Direct' END AS channel_group,
        count(*) AS bookings, sum(revenue) AS revenue, avg(is_canceled) AS cancel_rate, avg({PAID}) AS adr
        FROM b GROUP BY ALL""", r6="cancel_rate adr", r4="revenue")
    add("weekend_vs_weekday_stay", lambda x: K.weekend_vs_weekday_stay(x.bookings()),
        f"""SELECT hotel, CASE WHEN stays_in_weekend_nights > 0 AND stays_in_week_nights = 0 THEN 'Weekend only'
        WHEN stays_in_weekend_nights = 0 AND stays_in_week_nights > 0 THEN 'Weekday only' ELSE 'Mixed' END AS stay_pattern,
        count(*) AS bookings, avg(total_nights) AS avg_nights, avg({PAID}) AS adr, avg(is_canceled) AS cancel_rate
        FROM b GROUP BY ALL""", r6="avg_nights adr cancel_rate")
    add("status_mix", lambda x: K.status_mix(x.bookings()),
        """SELECT reservation_status, count(*) AS bookings, 100.0 * count(*) / sum(count(*)) OVER () AS share_pct
        FROM b GROUP BY reservation_status""", r6="share_pct")
    add("status_mix_by_hotel_year", lambda x: K.status_mix(
            x.bookings().withColumnRenamed("arrival_date_year", "year"), ["hotel", "year"]),
        """SELECT hotel, arrival_date_year AS year, reservation_status, count(*) AS bookings, 100.0 * count(*)
        / sum(count(*)) OVER (PARTITION BY hotel, arrival_date_year) AS share_pct FROM b
        GROUP BY hotel, arrival_date_year, reservation_status""", r6="share_pct")
    # --- the booking cube and everything answered from it
    add("booking_cube", cube, "SELECT * FROM cube ", r4="revenue")
    add("cube_slice", lambda x: K.cube_slice(cube(x), **SLICE), SLICE_SQL, r4="revenue")
    add("cube_kpis", lambda x: K.cube_kpis(cube(x)),
        f"SELECT {CUBE_SUMS} FROM cube ",
        r6="cancel_rate noshow_rate", r4="revenue lost_est")
    add("cube_monthly", lambda x: K.cube_monthly(cube(x)),
        f"SELECT year_month, {CUBE_SUMS} FROM cube GROUP BY year_month", r6="cancel_rate noshow_rate", r4="revenue lost_est")
    add("cube_by_key", lambda x: K.cube_by_key(cube(x), "country", min_bookings=200, limit=10),
        """SELECT country, sum(bookings)::BIGINT AS bookings, sum(canceled) / greatest(sum(bookings), 1) AS cancel_rate
        FROM cube GROUP BY country HAVING sum(bookings) >= 200
        ORDER BY cancel_rate DESC, country NULLS FIRST LIMIT 10""", r6="cancel_rate")
    add("cube_lead_bins", lambda x: K.cube_by_key(cube(x), "lead_bin"),
        """SELECT lead_bin, sum(bookings)::BIGINT AS bookings, sum(canceled) / sum(bookings) AS cancel_rate
        FROM cube GROUP BY lead_bin""", r6="cancel_rate")
    add("cube_top_channels", lambda x: K.cube_top(cube(x), "channel", "revenue"),
        """SELECT channel, sum(bookings)::BIGINT AS bookings, sum(revenue) AS revenue FROM cube GROUP BY channel
        ORDER BY revenue DESC, channel LIMIT 10""", r4="revenue")
    add("cube_distinct", lambda x: K.cube_distinct(cube(x), "country"),
        "SELECT DISTINCT country AS value FROM cube WHERE country IS NOT NULL AND country <> ''")
    add("month_spine", lambda x: K.month_spine(x.bookings()),
        """SELECT strftime(unnest(generate_series(strptime(min(year_month) || '-01', '%Y-%m-%d'),
        strptime(max(year_month) || '-01', '%Y-%m-%d'), INTERVAL 1 MONTH)), '%Y-%m') AS year_month FROM b """)
    panels = {
        "segment": ("market_segment", ["bookings", "canceled", "avg_adr", "revenue"]),
        "countries": ("country", ["bookings", "cancel_rate", "revenue"]),
        "cancel_lead": ("lead_bin", ["bookings", "cancel_rate"]),
        "cancel_deposit": ("deposit_type", ["bookings", "cancel_rate"]),
        "cancel_channel": ("distribution_channel", ["bookings", "cancel_rate"]),
        "cancel_segment": ("market_segment", ["bookings", "cancel_rate"]),
    }
    sql_of = {"bookings": "count(*) AS bookings", "canceled": "sum(is_canceled)::BIGINT AS canceled",
              "avg_adr": "avg(adr) AS avg_adr", "revenue": "sum(revenue) AS revenue",
              "cancel_rate": "avg(is_canceled) AS cancel_rate"}
    for name, (dim, measures) in panels.items():
        expr = f"{LEAD_BIN} AS lead_bin" if dim == "lead_bin" else dim
        add(f"export_{name}",
            lambda x, d=dim, m=measures: K.export_by(
                x.bookings(part=d == "deposit_type", nation=d == "country"), d, m),
            f"SELECT hotel, arrival_date_year AS year, {expr}, {', '.join(sql_of[m] for m in measures)} FROM b GROUP BY ALL",
            r6=" ".join(m for m in measures if m in ("cancel_rate", "avg_adr")),
            r4="revenue" if "revenue" in measures else "")
    add("table_meta", lambda x: K.table_meta(x.monthly()),
        """SELECT min(year_month) AS min_month, max(year_month) AS max_month,
        (SELECT string_agg(hotel, ',' ORDER BY hotel) FROM (SELECT DISTINCT hotel FROM mon )) AS hotels,
        (SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FROM (SELECT DISTINCT year FROM mon )) AS years FROM mon """)
