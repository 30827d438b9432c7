"""Catalog entries: cancellation analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.functions.exprs import bookings
from lodgemetrics.operators import cancel as C
from lodgemetrics.operators import kpi as K
from lodgemetrics.plans.bridge_sql import LEAD_BIN, LEAD_EDA, LEAD_ORDER, PAID
from lodgemetrics.plans.catalog import Catalog

CANCEL_COLS = f"""count(*) AS bookings, count(*) FILTER (is_canceled = 1) AS canceled, avg(is_canceled) AS cancel_rate,
  sum(revenue) AS revenue, avg({PAID}) AS adr"""
KPI_SQL = """count(*) AS bookings, count(*) FILTER (is_canceled = 1) AS canceled,
  count(*) FILTER (reservation_status = 'No-Show') AS no_show, sum(revenue) AS revenue, avg(is_canceled) AS cancel_rate,
  avg(CASE WHEN reservation_status = 'No-Show' THEN 1.0 ELSE 0.0 END) AS no_show_rate,
  sum(revenue) * avg(is_canceled) / greatest(1 - avg(is_canceled), 0.01) * 0.35 AS lost_revenue_est"""
BOX_SQL = """count({v}) AS n, avg({v}) AS mean, CAST(min({v}) AS DOUBLE) AS min, CAST(max({v}) AS DOUBLE) AS max,
  quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median, quantile_cont({v}, 0.75) AS q3"""
BOX6 = "mean min max q1 median q3"
LABEL = "CASE WHEN is_canceled = 1 THEN 'Canceled' ELSE 'Not canceled' END"
VALUE = "(greatest(adr, 0.0) * greatest(total_nights, 0))"
TIES = ["hotel", "adr", "arrival_date", "lead_time"]
HASH = f"((booking_key % {C.HASH_MOD}) * {C.HASH_MUL % C.HASH_MOD} + {C.HASH_ADD}) % {C.HASH_MOD}"


def _sample_sql(by: str) -> str:
    return f"""SELECT {by.split(' AS ')[-1]}, booking_key, hotel, adr, CAST(dense_rank() OVER (PARTITION BY {by.split(' AS ')[-1]}
      ORDER BY booking_key) AS INTEGER) AS sample_index FROM (SELECT *, row_number() OVER (PARTITION BY {by.split(' AS ')[0]}
      ORDER BY {HASH}, booking_key, {', '.join(TIES)}) AS rn, {by} FROM b ) WHERE rn <= 800"""


def _funnel_sql(kept: str) -> str:
    return f"""SELECT stage_order, stage, n, 100.0 * n / max(n) FILTER (stage_order = 1) OVER () AS vs_top_pct FROM (
      SELECT 1 AS stage_order, 'Bookings' AS stage, count(*) AS n FROM b
      UNION ALL SELECT 2, 'After cancel leak', count(*) FILTER ({kept}) FROM b
      UNION ALL SELECT 3, 'Check-Out', count(*) FILTER (reservation_status = 'Check-Out') FROM b )"""


def _hotspot(name: str, inside: str) -> str:
    return f"""SELECT '{name}' AS hotspot, count(*) FILTER ({inside}) AS bookings,
      count(*) FILTER ({inside} AND is_canceled = 1) AS canceled, avg(is_canceled) FILTER ({inside}) AS cancel_rate,
      coalesce(sum({VALUE}) FILTER ({inside} AND is_canceled = 1), 0.0) AS revenue_loss,
      100.0 * coalesce(sum({VALUE}) FILTER ({inside} AND is_canceled = 1), 0.0) / sum({VALUE}) FILTER (is_canceled = 1)
      AS pct_total_loss, avg(adr) FILTER ({inside} AND is_canceled = 1) AS mean_adr_canceled FROM b """


def _gap_sql(dim: str, name: str, metric: str, label: str, scale: str = "1") -> str:
    return f"""SELECT {name}, city, resort, (city - resort) * {scale} AS {label} FROM (SELECT {dim} AS {name},
      {metric} FILTER (hotel = 'City Hotel') AS city, {metric} FILTER (hotel = 'Resort Hotel') AS resort
      FROM b GROUP BY 1)"""


LOSS = f"""sum({VALUE}) FILTER (is_canceled = 1) AS total_loss, sum({VALUE}) AS potential_revenue,
  sum({VALUE}) FILTER (is_canceled = 0) AS realized_revenue,
  count(*) FILTER (is_canceled = 1 AND {VALUE} > 0) AS lost_bookings,
  avg({VALUE}) FILTER (is_canceled = 1 AND {VALUE} > 0) AS mean_loss_per_booking,
  sum({VALUE}) FILTER (is_canceled = 1 AND {VALUE} > 0) / sum(total_nights) FILTER (is_canceled = 1 AND {VALUE} > 0)
  AS mean_loss_per_night, 100.0 * sum({VALUE}) FILTER (is_canceled = 1) / sum({VALUE}) AS loss_pct_of_potential"""


def register(cat: Catalog) -> None:
    add = cat.add
    add("cancel_kpi", lambda x: C.cancel_kpi(x.bookings()), f"SELECT {KPI_SQL} FROM b ",
        r6="cancel_rate no_show_rate", r4="revenue lost_revenue_est")
    add("cancel_kpi_by_hotel", lambda x: C.cancel_kpi(x.bookings(), ["hotel"]),
        f"SELECT hotel, {KPI_SQL} FROM b GROUP BY hotel", r6="cancel_rate no_show_rate", r4="revenue lost_revenue_est")
    add("monthly_rate_series", lambda x: C.monthly_rate_series(x.bookings(), ["hotel"]),
        """SELECT hotel, year_month, avg(is_canceled) * 100 AS cancel_rate_pct, avg(adr) AS mean_adr, count(*) AS bookings
        FROM b GROUP BY ALL""", r6="cancel_rate_pct mean_adr")
    add("cancel_trend", lambda x: C.cancel_trend(x.bookings()),
        """SELECT year_month, hotel, count(*) AS bookings, avg(is_canceled) AS cancel_rate,
        avg(CASE WHEN reservation_status = 'No-Show' THEN 1.0 ELSE 0.0 END) AS no_show_rate FROM b GROUP BY ALL""",
        r6="cancel_rate no_show_rate")
    add("cancel_by_lead_bin", lambda x: C.cancel_by(x.bookings(), [
            bands.lead_time_bin().alias("lead_time_bin"), bands.lead_time_bin_order().alias("lead_time_bin_order")]),
        f"SELECT {LEAD_BIN} AS lead_time_bin, {LEAD_ORDER} AS lead_time_bin_order, {CANCEL_COLS} FROM b GROUP BY 1, 2",
        r6="cancel_rate adr", r4="revenue")
    add("cancel_by_deposit", lambda x: C.cancel_by(x.bookings(part=True), ["deposit_type"]).withColumn(
            "insight", C.cancel_insight("deposit_type")),
        f"""SELECT deposit_type, {CANCEL_COLS}, CASE deposit_type WHEN 'Non Refund' THEN 'audit non-refundable bookings'
        WHEN 'No Deposit' THEN 'largest group: use lead time and CRM' ELSE 'small sample: read with bookings' END AS insight
        FROM b GROUP BY deposit_type""", r6="cancel_rate adr", r4="revenue")
    add("cancel_by_channel", lambda x: C.cancel_by(x.bookings(), ["distribution_channel"]),
        f"SELECT distribution_channel, {CANCEL_COLS} FROM b GROUP BY 1", r6="cancel_rate adr", r4="revenue")
    add("cancel_by_segment", lambda x: C.cancel_by(x.bookings(), ["market_segment"], 50).withColumn(
            "insight", C.cancel_insight("market_segment")),
        f"""SELECT market_segment, {CANCEL_COLS}, CASE WHEN market_segment = 'Groups' THEN 'inelastic: harden contracts'
        WHEN market_segment LIKE 'Offline%' THEN 'elastic: promote offline first' ELSE 'watch mix against Direct' END AS insight
        FROM b GROUP BY market_segment HAVING count(*) >= 50""", r6="cancel_rate adr", r4="revenue")
    add("cancel_by_lead_deposit", lambda x: C.cancel_by(x.bookings(part=True), [
            bands.lead_time_bin().alias("lead_time_bin"), "deposit_type"], 30),
        f"SELECT {LEAD_BIN} AS lead_time_bin, deposit_type, {CANCEL_COLS} FROM b GROUP BY 1, 2 HAVING count(*) >= 30",
        r6="cancel_rate adr", r4="revenue")
    add("booking_funnel", lambda x: C.booking_funnel(x.bookings()), _funnel_sql("is_canceled = 0"), r6="vs_top_pct")
    add("booking_funnel_status", lambda x: C.booking_funnel(x.bookings(), no_show_leaks=False),
        _funnel_sql("reservation_status <> 'Canceled'"), r6="vs_top_pct")
    add("adr_by_cancel_label", lambda x: C.adr_by_cancel_label(x.bookings()),
        f"""SELECT {LABEL} AS cancel_label, count(*) AS bookings, avg(adr) AS adr_mean, min(adr) AS adr_min, max(adr) AS adr_max
        FROM b WHERE adr > 0 GROUP BY 1""", r6="adr_mean adr_min adr_max")
    add("boxplot_stats", lambda x: C.boxplot_stats(x.bookings().withColumn("label", bands.cancel_label()),
                                                   ["hotel", "arrival_date_year", "label"]),
        f"SELECT hotel, arrival_date_year, {LABEL} AS label, {BOX_SQL.format(v='adr')} FROM b GROUP BY 1, 2, 3", r6=BOX6)
    add("lead_cancel_rate_samples", lambda x: C.lead_cancel_rate_samples(K.booking_cube(x.bookings(part=True, nation=True))),
        f"""SELECT lead_bin, {BOX_SQL.format(v='rate')} FROM (SELECT lead_bin, 100.0 * sum(canceled) / sum(bookings) AS rate
        FROM cube GROUP BY lead_bin, year_month, hotel HAVING sum(bookings) >= 15) GROUP BY lead_bin""", r6=BOX6)
    add("hash_sample_topn", lambda x: C.hash_sample_topn(
            x.bookings().withColumn("cancel_label", bands.cancel_label()), ["cancel_label"], 800, ties=TIES).select(
            "cancel_label", "booking_key", "hotel", "adr", "sample_index"),
        _sample_sql(f"{LABEL} AS cancel_label"), r6="adr")
    add("hash_sample_topn_lead", lambda x: C.hash_sample_topn(
            x.bookings().withColumn("lead_bin", bands.lead_time_bin()), ["lead_bin"], 800, ties=TIES).select(
            "lead_bin", "booking_key", "hotel", "adr", "sample_index"),
        _sample_sql(f"{LEAD_BIN} AS lead_bin"), r6="adr")
    add("random_sample_cap", lambda x: C.random_sample_cap(
            x.bookings(), ["hotel", "arrival_date_year", "is_canceled"], 1500,
            key=["booking_key", "adr", "lead_time", "arrival_date"])
        .groupBy("hotel", "arrival_date_year", "is_canceled").agg(bookings(), F.countDistinct("booking_key").alias("keys"))
        .select("hotel", "arrival_date_year", "is_canceled", "bookings"),
        """SELECT hotel, arrival_date_year, is_canceled, least(count(*), 1500) AS bookings FROM b GROUP BY 1, 2, 3""")
    channels = ["Corporate", "Direct", "GDS", "TA/TO"]
    picks = ", ".join(f"avg(is_canceled) FILTER (distribution_channel = '{c}') AS \"{c}\"" for c in channels)
    picks += f", avg(is_canceled) FILTER (distribution_channel IS NULL OR distribution_channel NOT IN ({', '.join(repr(c) for c in channels)})) AS other"
    cat.add("crosstab_rate", lambda x: C.crosstab_rate(x.bookings(), "market_segment", "distribution_channel", channels)
            .withColumnsRenamed({"TA/TO": "ta_to"}),
            f"SELECT market_segment, {picks.replace(chr(34) + 'TA/TO' + chr(34), 'ta_to')} FROM b GROUP BY market_segment",
            r6="Corporate Direct GDS ta_to other")
    add("crosstab_share", lambda x: C.crosstab_share(
            x.bookings().withColumn("lead_bin", bands.lead_time_bin("lead_time", "eda")), "lead_bin"),
        f"""SELECT {LEAD_EDA} AS lead_bin, 1 - avg(is_canceled) AS stayed_share, avg(is_canceled) AS canceled_share
        FROM b GROUP BY 1""", r6="stayed_share canceled_share")
    add("hotel_gap_cancel", lambda x: C.hotel_gap(
            x.bookings(), bands.lead_time_bin("lead_time", "eda").alias("lead_bin"),
            F.avg(F.col("is_canceled").cast("double")), "gap_pp", 100.0),
        _gap_sql(LEAD_EDA, "lead_bin", "avg(is_canceled)", "gap_pp", "100"), r6="city resort gap_pp")
    add("hotel_gap_adr", lambda x: C.hotel_gap(x.stays(), "day_of_week", F.avg("adr")),
        _gap_sql("day_of_week", "day_of_week", "avg(adr)", "gap").replace("FROM b GROUP", "FROM stays GROUP"),
        r6="city resort gap")
    add("lead_time_stats_by_status", lambda x: C.lead_time_stats_by_status(x.bookings()),
        """SELECT is_canceled, count(*) AS n, avg(lead_time) AS mean, stddev_samp(lead_time) AS std,
        CAST(min(lead_time) AS DOUBLE) AS min, CAST(max(lead_time) AS DOUBLE) AS max,
        quantile_cont(lead_time, 0.5) AS median FROM b GROUP BY is_canceled""", r6="mean std min max median")
    add("density_histogram", lambda x: C.density_histogram(x.bookings(), ["is_canceled"]),
        """SELECT is_canceled, bin, bin * (top / 40) AS bin_start, n,
        n / (sum(n) OVER (PARTITION BY is_canceled) * (top / 40)) AS density FROM (
          SELECT is_canceled, top, least(CAST(floor(lead_time / (top / 40)) AS INTEGER), 39) AS bin, count(*) AS n
          FROM b, (SELECT least(quantile_cont(lead_time, 0.99), 365.0) AS top FROM b ) WHERE lead_time <= top GROUP BY 1, 2, 3)""",
        r6="bin_start density")
    peak = "arrival_month_number IN (7, 8) AND market_segment = 'Online TA'"
    add("hotspot_3d", lambda x: C.hotspot_3d(x.bookings()), " UNION ALL ".join([
        _hotspot("online_lead90_peak", f"{peak} AND lead_time > 90"),
        _hotspot("online_ta_lead60_peak", f"{peak} AND distribution_channel = 'TA/TO' AND lead_time > 60")]),
        r6="cancel_rate pct_total_loss mean_adr_canceled", r4="revenue_loss")
    for name, by in (("", []), ("_by_month", ["arrival_month_number"]), ("_by_hotel", ["hotel"])):
        keys = ", ".join(by)
        add(f"revenue_loss{name}", lambda x, k=by: C.revenue_loss(x.bookings(), k),
            f"SELECT {keys + ', ' if keys else ''}{LOSS} FROM b {'GROUP BY ' + keys if keys else ''}",
            r6="mean_loss_per_booking mean_loss_per_night loss_pct_of_potential",
            r4="total_loss potential_revenue realized_revenue")
    add("deposit_scenario", lambda x: C.deposit_scenario(x.bookings()),
        f"""SELECT n AS bookings, cx AS cancel_rate, base AS baseline_net, n * 0.9 AS scenario_bookings,
        cx * 0.7 AS scenario_cancel_rate, net AS scenario_net, net - base AS net_change,
        100.0 * (net - base) / base AS net_change_pct, net + dep AS scenario_net_with_deposit,
        net + dep - base AS net_change_with_deposit FROM (SELECT *, n * 0.9 * v * (1 - cx * 0.7) AS net,
          n * 0.9 * (1 - cx * 0.7) * a * 0.8 AS dep FROM (SELECT count(*) AS n, avg(is_canceled) AS cx,
          sum({VALUE}) FILTER (is_canceled = 0) AS base, avg({VALUE}) AS v, avg(adr) AS a FROM b
          WHERE market_segment = 'Online TA' AND lead_time > 30))""",
        r6="cancel_rate scenario_bookings scenario_cancel_rate net_change_pct",
        r4="baseline_net scenario_net net_change scenario_net_with_deposit net_change_with_deposit")
