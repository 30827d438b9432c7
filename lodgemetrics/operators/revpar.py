"""RevPAR comparison, bridges, time intelligence, daily quadrants and room roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.functions.exprs import (
    bookings, cancel_rate, count_if, lost_revenue, pct_change, ratio, revenue_sum, stayed, wavg,
)
from lodgemetrics.operators.kpi import weighted_kpis, whole
from lodgemetrics.schema import CITY, RESORT


def revpar_trend(monthly: DataFrame) -> DataFrame:
    return monthly.select("hotel", "year_month", "total_bookings", "adr", "occupancy_rate",
                          "revpar", "total_revenue")


def pivot_hotels(monthly: DataFrame) -> DataFrame:
    """City and Resort side by side per month."""
    def side(hotel: str, c: str) -> Column:
        return F.max(F.when(F.col("hotel") == hotel, F.col(c)))
    cols = []
    for c, name in (("total_revenue", "revenue"), ("adr", "adr"), ("revpar", "revpar")):
        cols += [side(CITY, c).alias(f"city_{name}"), side(RESORT, c).alias(f"resort_{name}")]
    return monthly.groupBy("year_month").agg(*cols)


def _bridge_terms(df: DataFrame) -> DataFrame:
    """Split a RevPAR change into price and occupancy parts (columns *_pm = previous)."""
    price = F.col("occ_pm") * (F.col("adr") - F.col("adr_pm"))
    volume = F.col("adr") * (F.col("occupancy_rate") - F.col("occ_pm"))
    return (df.withColumn("delta_from_adr", price).withColumn("delta_from_occupancy", volume)
            .withColumn("residual", F.col("revpar") - (F.col("revpar_pm") + price + volume)))


def revpar_bridge(monthly: DataFrame) -> DataFrame:
    """Month-on-month RevPAR bridge per hotel with the dominating driver."""
    w = W.partitionBy("hotel").orderBy("year_month")
    lagged = monthly.select(
        "hotel", "year_month", "adr", "occupancy_rate", "revpar", F.lag("adr").over(w).alias("adr_pm"),
        F.lag("occupancy_rate").over(w).alias("occ_pm"), F.lag("revpar").over(w).alias("revpar_pm"))
    out = _bridge_terms(lagged.where(F.col("adr_pm").isNotNull()))
    driver = F.when(F.abs("delta_from_adr") >= F.abs("delta_from_occupancy"), "price").otherwise("occupancy")
    return out.select("hotel", "year_month", F.col("revpar_pm").alias("revpar_prev"),
                      "delta_from_adr", "delta_from_occupancy", F.col("revpar").alias("revpar_curr"),
                      "residual", driver.alias("driver"))


def revpar_bridge_latest(monthly: DataFrame) -> DataFrame:
    """Waterfall steps between the last two portfolio months."""
    m = monthly.groupBy("year_month").agg(
        wavg("adr", "successful_bookings").alias("adr"),
        wavg("occupancy_rate", "total_bookings").alias("occupancy_rate"),
        wavg("revpar", "total_bookings").alias("revpar"))
    w = whole().orderBy(F.desc("year_month"))
    last = m.select("year_month", "adr", "occupancy_rate", "revpar",
                    F.lead("adr").over(w).alias("adr_pm"),
                    F.lead("occupancy_rate").over(w).alias("occ_pm"),
                    F.lead("revpar").over(w).alias("revpar_pm"), F.row_number().over(w).alias("rn"))
    out = _bridge_terms(last.where("rn = 1 AND revpar_pm IS NOT NULL"))
    return out.selectExpr(
        "stack(5, 1, 'Prev RevPAR', revpar_pm, 2, 'Delta ADR', delta_from_adr,"
        " 3, 'Delta Occupancy', delta_from_occupancy, 4, 'Curr RevPAR', revpar,"
        " 5, 'Residual', residual) AS (step_order, step, value)")


def season_heatmap(monthly: DataFrame, scaled: bool = False) -> DataFrame:
    """Weighted RevPAR per hotel and month of year; ``scaled`` adds a 0..1 colour position."""
    out = (monthly.groupBy("hotel", "month_number")
           .agg(wavg("revpar", "total_bookings").alias("revpar_wtd"))
           .withColumn("season", bands.season("month_number")))
    if scaled:
        low, high = F.min("revpar_wtd").over(whole()), F.max("revpar_wtd").over(whole())
        out = out.withColumn("heat", ratio(F.col("revpar_wtd") - low, high - low))
    return out


def season_playbook(monthly: DataFrame) -> DataFrame:
    """Season KPIs with the asymmetric rate playbook."""
    city, resort = F.col("hotel") == CITY, F.col("hotel") == RESORT
    label = (F.when(city & (F.col("season") == "Peak"), "RAISE")
             .when(resort & (F.col("season") == "Peak"), "HOLD")
             .when(resort & (F.col("season") == "Low"), "CUT").otherwise("HOLD in band"))
    return (monthly.groupBy("hotel", bands.season("month_number").alias("season"))
            .agg(*weighted_kpis()).withColumn("playbook", label))


def latest_month(monthly: DataFrame) -> DataFrame:
    """Hotels at the last month; rank() <= 1 keeps only last-month rows before they meet."""
    ranked = monthly.withColumn("_rk", F.rank().over(whole().orderBy(F.desc("year_month"))))
    return revpar_trend(ranked.where(F.col("_rk") <= 1))


def yoy(monthly: DataFrame) -> DataFrame:
    """RevPAR against the same month of the year before; a gap leaves NULL."""
    year_before = W.partitionBy("hotel", "month_number").orderBy("year").rangeBetween(-1, -1)
    return monthly.withColumn("revpar_py", F.max("revpar").over(year_before)).select(
        "hotel", "year_month", "revpar", "revpar_py", pct_change("revpar", "revpar_py").alias("revpar_yoy_pct"))


def measure_panel(monthly: DataFrame, by: list[str] = ()) -> DataFrame:
    """Additive pieces of every KPI per (by, year, month): the input of all CY/PY operators."""
    def weighted(v: str, w: str) -> Column:
        return F.sum(F.col(v) * F.col(w))
    return monthly.groupBy(*by, "year", "month_number").agg(
        F.sum("total_bookings").alias("tb"), F.sum("successful_bookings").alias("sb"),
        F.sum("canceled_bookings").alias("cb"), F.sum("no_show_bookings").alias("ns"),
        F.sum("total_revenue").alias("rev"), weighted("adr", "successful_bookings").alias("adr_w"),
        weighted("occupancy_rate", "total_bookings").alias("occ_w"),
        weighted("revpar", "total_bookings").alias("rp_w"))


#: Measures whose difference is one of percentage points.
RATES = ["occupancy_rate", "cancel_rate", "no_show_rate"]


def panel_measures() -> dict[str, Column]:
    """KPI formulas over sums of a measure panel."""
    def s(c: str) -> Column:
        return F.sum(c).cast("double")
    cx = ratio(F.sum("cb"), F.sum("tb"))
    return {
        "total_bookings": s("tb"), "total_revenue": s("rev"), "adr": ratio(s("adr_w"), s("sb")),
        "occupancy_rate": ratio(s("occ_w"), s("tb")), "revpar": ratio(s("rp_w"), s("tb")),
        "cancel_rate": cx, "no_show_rate": ratio(s("ns"), s("tb")), "canceled_bookings": s("cb"),
        "no_show_bookings": s("ns"), "lost_revenue": lost_revenue(s("rev"), cx),
    }


def _by_role(panel: DataFrame, role: Column, roles: list[str], by: list[str],
             measures: list[str] | None) -> DataFrame:
    """One row per (by, measure) with one value column per role."""
    formulas = panel_measures()
    names = measures or list(formulas)
    kpis = (panel.withColumn("role", role).where(F.col("role").isNotNull()).groupBy(*by, "role")
            .agg(*[formulas[n].alias(n) for n in names]))
    long = kpis.unpivot([*by, "role"], names, "measure", "value")
    return long.groupBy(*by, "measure").pivot("role", roles).agg(F.first("value", ignorenulls=True))


def _year_role(panel: DataFrame) -> DataFrame:
    """Mark rows CY (last year) or PY (year before, only months present in CY)."""
    cy = F.max("year").over(whole())
    tagged = panel.withColumn("_cy", cy)
    in_cy = F.max(F.when(F.col("year") == F.col("_cy"), 1)).over(W.partitionBy("month_number"))
    role = (F.when(F.col("year") == F.col("_cy"), "cy")
            .when((F.col("year") == F.col("_cy") - 1) & (F.col("_in_cy") == 1), "py"))
    return tagged.withColumn("_in_cy", in_cy).withColumn("_role", role)


def cy_vs_py(panel: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """Current year against the same months of the year before, for every measure at once."""
    out = _by_role(_year_role(panel), F.col("_role"), ["cy", "py"], [], measures)
    return (out.withColumn("delta", F.col("cy") - F.col("py"))
            .withColumn("delta_pct", pct_change("cy", "py")))


def cy_py_by_month(panel: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """Aligned month series of the current and the previous year."""
    tagged = _year_role(panel)
    role = (F.when(F.col("year") == F.col("_cy"), "cy")
            .when(F.col("year") == F.col("_cy") - 1, "py"))
    return _by_role(tagged, role, ["cy", "py"], ["month_number"], measures)


def same_month_py(panel: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """Last fact month against the previous month (pm) and the same month last year (py)."""
    idx = F.col("year") * 12 + F.col("month_number")
    tagged = panel.withColumn("_idx", idx).withColumn("_back", F.max("_idx").over(whole()) - F.col("_idx"))
    role = (F.when(F.col("_back") == 0, "current").when(F.col("_back") == 1, "pm")
            .when(F.col("_back") == 12, "py"))
    out = _by_role(tagged, role, ["current", "pm", "py"], [], measures)
    return (out.withColumn("mom_pct", pct_change("current", "pm"))
            .withColumn("yoy_pct", pct_change("current", "py"))
            .withColumn("mom_delta_pp", F.when(F.col("measure").isin(RATES), (F.col("current") - F.col("pm")) * 100)))


def kpi_rating(monthly: DataFrame, by: list[str] = ("hotel",)) -> DataFrame:
    """Five-band rating of ADR, occupancy and RevPAR."""
    out = monthly.groupBy(*by).agg(*weighted_kpis())
    return out.select(*by, "adr", "occupancy_rate", "revpar",
                      *[bands.kpi_rating(k, k).alias(f"{k}_rating")
                        for k in ("adr", "occupancy_rate", "revpar")])


def change_sign_label(series: DataFrame, change: str) -> DataFrame:
    """Sign and arrow label of a fractional change column."""
    return (series.withColumn("change_sign", bands.change_sign(change))
            .withColumn("change_label", bands.change_label(change)))


QUADRANTS = {
    (True, True): "High ADR + High Occ", (False, True): "Low ADR + High Occ",
    (True, False): "High ADR + Low Occ", (False, False): "Low ADR + Low Occ",
}


def adr_occ_quadrant(daily: DataFrame) -> DataFrame:
    """Place each hotel-day against the overall mean ADR and occupancy (one scalar subquery)."""
    days = daily.where(F.col("adr").isNotNull())
    means = days.agg(F.struct(F.avg("adr").alias("adr"), F.avg("occupancy_rate").alias("occ"))).scalar()
    high_adr = F.col("adr") >= means["adr"]
    high_occ = F.col("occupancy_rate") >= means["occ"]
    label = (F.when(high_adr & high_occ, QUADRANTS[True, True])
             .when(~high_adr & high_occ, QUADRANTS[False, True])
             .when(high_adr & ~high_occ, QUADRANTS[True, False])
             .otherwise(QUADRANTS[False, False]))
    return days.select("hotel", "arrival_date", "adr", "occupancy_rate", "revpar", "bookings",
                       label.alias("quadrant"))


def quadrant_summary(quadrants: DataFrame) -> DataFrame:
    out = quadrants.groupBy("hotel", "quadrant").agg(F.count(F.lit(1)).alias("days"),
                                                     F.avg("revpar").alias("avg_revpar"))
    total = F.sum("days").over(W.partitionBy("hotel"))
    return out.withColumn("day_share_pct", 100.0 * ratio("days", total))


def daily_segments(df: DataFrame) -> DataFrame:
    """Bookings per hotel-day as a segment -> count map."""
    per = df.groupBy("hotel", "arrival_date", "market_segment").agg(F.count(F.lit(1)).alias("n"))
    pair = F.struct(F.col("market_segment").alias("key"), F.col("n").alias("value"))
    return per.groupBy("hotel", "arrival_date").agg(
        F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("segments"))


def daily_points(daily: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Bookings-weighted ADR and occupancy across hotels per day, with summed segment counts."""
    w = F.when(F.col("bookings") > 0, F.col("bookings")).otherwise(1).cast("double")
    points = daily.groupBy("arrival_date", "year", "year_month").agg(
        ratio(F.sum(F.coalesce("adr", F.lit(0.0)) * w), F.sum(w)).alias("adr"),
        ratio(F.sum(F.coalesce("occupancy_rate", F.lit(0.0)) * w), F.sum(w)).alias("occupancy_rate"),
        F.sum("revenue").alias("revenue"), F.sum("bookings").alias("bookings"),
        F.sum("canceled").alias("canceled"), F.sum("room_nights_sold").alias("room_nights"),
        F.sum("available_room_nights").alias("available_room_nights"))
    points = (points.withColumn("revpar", F.col("adr") * F.col("occupancy_rate"))
              .withColumn("cancel_rate", ratio("canceled", "bookings")))
    if segments is None:
        return points
    summed = (segments.select("arrival_date", F.explode("segments"))
              .groupBy("arrival_date", "key").agg(F.sum("value").alias("value"))
              .groupBy("arrival_date")
              .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
                   .alias("segments")))
    return points.join(summed, "arrival_date", "left")


def _sold() -> Column:
    return F.sum(F.when(stayed(), F.col("total_nights")).otherwise(0))


def revpar_by_room(df: DataFrame, role: str = "reserved") -> DataFrame:
    """Revenue per sold night by room type in one role."""
    return df.groupBy(F.col(f"{role}_room_type").alias("room_type")).agg(
        bookings(), _sold().alias("room_nights_sold"), revenue_sum(),
        ratio(F.sum("revenue"), _sold()).alias(f"revpar_{role}"))


def room_type_both_sides(df: DataFrame) -> DataFrame:
    """Reserved and assigned view per hotel and year; revenue per booked night.

    Without nights the mean hotel-month RevPAR of the bookings stands in. Bookings collapse once
    to hotel, month and room pair; the hotel-month context and both roles come from that table.
    """
    pairs = df.groupBy("hotel", F.col("arrival_date_year").alias("year"), "year_month",
                       "reserved_room_type", "assigned_room_type").agg(
        bookings(), F.sum("revenue").alias("revenue"), F.sum("total_nights").alias("room_nights"),
        F.sum("adr").alias("_adr"), count_if(stayed()).alias("_stays"),
        F.sum(F.when(stayed(), F.col("adr"))).alias("_stay_adr"))
    month = W.partitionBy("hotel", "year_month")
    context = ratio(F.sum("_stay_adr").over(month), F.sum("_stays").over(month)) * ratio(
        F.sum("_stays").over(month), F.sum("bookings").over(month))
    sides = F.explode(F.array(*[
        F.struct(F.lit(r).alias("side"), F.col(f"{r}_room_type").alias("room_type"))
        for r in ("reserved", "assigned")])).alias("s")
    rows = pairs.withColumn("_rp", context * F.col("bookings")).select("*", sides)
    n = F.sum("bookings")
    out = rows.groupBy("hotel", "year", "s.side", "s.room_type").agg(
        n.alias("bookings"), F.sum("revenue").alias("revenue"), F.sum("room_nights").alias("room_nights"),
        ratio(F.sum("_adr"), n).alias("avg_adr"), ratio(F.sum("_rp"), n).alias("avg_revpar"))
    return out.withColumn("revpar", F.coalesce(ratio("revenue", "room_nights"), "avg_revpar"))


def room_type_grouped(sides: DataFrame, limit: int = 8) -> DataFrame:
    """Bookings-weighted RevPAR per room type, reserved next to assigned."""
    def side(name: str) -> Column:
        mine = F.col("side") == name if name == "reserved" else F.col("side") != "reserved"
        return F.coalesce(ratio(F.sum(F.when(mine, F.col("revpar") * F.col("bookings"))),
                                F.sum(F.when(mine, F.col("bookings")))), F.lit(0.0))
    return (sides.groupBy("room_type").agg(F.sum("bookings").alias("bookings"),
                                           side("reserved").alias("reserved"),
                                           side("assigned").alias("assigned"))
            .orderBy(F.desc("bookings"), "room_type").limit(limit))


def room_mismatch_rate(df: DataFrame) -> DataFrame:
    flag = bands.room_mismatch_flag()
    return df.groupBy("hotel").agg(
        bookings(), F.sum(flag).alias("room_changed"),
        F.avg(flag.cast("double")).alias("mismatch_rate"), cancel_rate())
