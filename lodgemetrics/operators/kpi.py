"""KPI, share and mix queries, and the re-aggregatable booking cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.functions.exprs import (
    NO_SHOW, bookings, cancel_rate, col, count_if, lost_revenue, paid_stay, pct_change, ratio,
    revenue_sum, stay_adr, stayed, wavg,
)
from lodgemetrics.schema import TOP_CUSTOMER_TYPES

def whole():
    """One window over an already aggregated, small table."""
    return W.partitionBy(F.lit(1))


def weighted_kpis() -> list[Column]:
    """Roll-up of the monthly fact: rates are weighted, never averaged."""
    return [
        F.sum("total_bookings").alias("bookings"), F.sum("total_revenue").alias("revenue"),
        wavg("adr", "successful_bookings").alias("adr"),
        wavg("occupancy_rate", "total_bookings").alias("occupancy_rate"),
        wavg("revpar", "total_bookings").alias("revpar"),
        ratio(F.sum("canceled_bookings"), F.sum("total_bookings")).alias("cancel_rate"),
    ]


def kpi_total(monthly: DataFrame) -> DataFrame:
    return monthly.agg(*weighted_kpis())


def kpi_direct(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """The same KPIs straight from bookings, without the monthly grain."""
    aggs = [bookings(), count_if(stayed()).alias("successful_bookings"), revenue_sum(), stay_adr(),
            F.avg(1.0 - F.col("is_canceled")).alias("occupancy_rate"), cancel_rate()]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return out.withColumn("revpar", F.col("adr") * F.col("occupancy_rate"))


def weighted_mean(df: DataFrame, value: str, weight: str, by: list[str] = ()) -> DataFrame:
    """Weighted mean per group, 0 when no row carries weight."""
    agg = F.coalesce(wavg(value, weight), F.lit(0.0)).alias(f"{value}_wtd")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def monthly_baseline(df: DataFrame) -> DataFrame:
    return kpi_direct(df, ["year_month"])


def monthly_revenue_mom(monthly: DataFrame) -> DataFrame:
    m = monthly.groupBy("year_month").agg(F.sum("total_bookings").alias("bookings"),
                                          F.sum("total_revenue").alias("revenue"))
    before = F.lag("revenue").over(whole().orderBy("year_month"))
    return m.withColumn("revenue_mom_pct", pct_change("revenue", before))


def monthly_trends(monthly: DataFrame) -> DataFrame:
    """Portfolio KPIs per month; a month without stays still weighs 1 in ADR."""
    weight = F.greatest("successful_bookings", F.lit(1))
    return monthly.groupBy("year_month").agg(
        F.sum("total_bookings").alias("total_bookings"),
        F.sum("successful_bookings").alias("successful_bookings"),
        F.sum("canceled_bookings").alias("canceled_bookings"),
        F.sum("total_revenue").alias("total_revenue"),
        wavg("adr", weight).alias("adr"),
        wavg("occupancy_rate", "total_bookings").alias("occupancy_rate"),
        wavg("revpar", "total_bookings").alias("revpar"),
        ratio(F.sum("canceled_bookings"), F.greatest(F.sum("total_bookings"), F.lit(1)))
        .alias("cancel_rate"))


def _share(value: str) -> Column:
    return 100.0 * ratio(value, F.sum(value).over(whole()))


def revenue_share_by(df: DataFrame, dim: str, flag_at: float = 50.0) -> DataFrame:
    """Revenue share per category with a concentration flag."""
    out = df.groupBy(dim).agg(bookings(), revenue_sum())
    share = _share("revenue")
    return (out.withColumn("revenue_share_pct", share)
            .withColumn("insight", F.when(F.col("revenue_share_pct") >= flag_at, "concentration risk")
                        .otherwise("acceptable")))


def segment_mix(df: DataFrame, dim: str = "market_segment") -> DataFrame:
    out = df.groupBy(dim).agg(bookings(), revenue_sum(), cancel_rate())
    return out.withColumn("revenue_share_pct", _share("revenue"))


def top_countries(df: DataFrame, n: int = 10, by: str = "revenue") -> DataFrame:
    """Top countries; the share is of all countries, taken before the cut."""
    name = F.coalesce("country", F.lit("(blank)")).alias("country_code")
    out = df.groupBy(name).agg(bookings(), revenue_sum(), cancel_rate())
    return (out.withColumn("revenue_share_pct", _share("revenue"))
            .orderBy(F.desc(by), "country_code").limit(n))


def kpi_by_hotel(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("hotel").agg(*weighted_kpis())


def customer_type_monthly(df: DataFrame) -> DataFrame:
    nights = F.sum(F.when(stayed(), F.col("total_nights")).otherwise(0)).alias("room_nights")
    return df.groupBy("year_month", "customer_type").agg(
        bookings(), nights, revenue_sum(), cancel_rate())


def customer_type_topn_other(df: DataFrame, keep: list[str] = TOP_CUSTOMER_TYPES) -> DataFrame:
    """Per hotel, year and month; types outside ``keep`` become Other."""
    kind = F.when(F.col("customer_type").isin(keep), F.col("customer_type")).otherwise("Other")
    return df.groupBy("hotel", F.col("arrival_date_year").alias("year"), "year_month",
                      kind.alias("customer_type")).agg(
        bookings(), revenue_sum(), F.sum("total_nights").alias("room_nights"),
        F.avg("adr").alias("avg_adr"))


def customer_type_series(ct: DataFrame, metric: str = "revenue",
                         keep: list[str] = TOP_CUSTOMER_TYPES) -> DataFrame:
    """One column per kept type and month, 0 where a type has no bookings."""
    return ct.groupBy("year_month").pivot("customer_type", keep).agg(F.sum(metric)).na.fill(0)


def customer_type_share(df: DataFrame) -> DataFrame:
    out = df.groupBy("customer_type").agg(bookings(), revenue_sum(), cancel_rate(), stay_adr())
    return out.withColumn("revenue_share_pct", _share("revenue"))


def repeat_vs_new(df: DataFrame) -> DataFrame:
    return df.groupBy(bands.guest_type().alias("guest_type"), "hotel").agg(
        bookings(), cancel_rate(), revenue_sum())


def special_requests_effect(df: DataFrame) -> DataFrame:
    return df.groupBy(bands.special_request_band().alias("special_requests")).agg(
        bookings(), cancel_rate(), stay_adr())


def prev_cancel_effect(df: DataFrame) -> DataFrame:
    return df.groupBy(bands.prev_cancel_band().alias("prev_cancel_band")).agg(
        bookings(), cancel_rate())


def direct_vs_nondirect(df: DataFrame) -> DataFrame:
    return df.groupBy("hotel", bands.channel_group().alias("channel_group")).agg(
        bookings(), revenue_sum(), cancel_rate(), stay_adr())


def weekend_vs_weekday_stay(df: DataFrame) -> DataFrame:
    return df.groupBy("hotel", bands.stay_pattern().alias("stay_pattern")).agg(
        bookings(), F.avg(F.col("total_nights").cast("double")).alias("avg_nights"),
        stay_adr(), cancel_rate())


def status_mix(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Bookings per status with the share inside ``by`` (all bookings when empty)."""
    out = df.groupBy(*by, "reservation_status").agg(bookings())
    total = W.partitionBy(*by) if by else whole()
    return out.withColumn("share_pct", 100.0 * ratio("bookings", F.sum("bookings").over(total)))


CUBE_KEYS = ["hotel", "year", "year_month", "lead_bin", "deposit_type", "channel", "segment",
             "status", "country"]


def booking_cube(df: DataFrame) -> DataFrame:
    """Nine-dimension aggregate every dashboard slice is answered from."""
    return df.groupBy(
        "hotel", F.col("arrival_date_year").alias("year"), "year_month",
        bands.lead_time_bin().alias("lead_bin"), "deposit_type",
        F.col("distribution_channel").alias("channel"), F.col("market_segment").alias("segment"),
        F.col("reservation_status").alias("status"), "country",
    ).agg(bookings(), F.sum("is_canceled").alias("canceled"),
          count_if(F.col("reservation_status") == NO_SHOW).alias("noshow"), revenue_sum())


def month_range(month_from: str | None = None, month_to: str | None = None,
                c: str = "year_month") -> Column:
    """Inclusive yyyy-MM range; an open bound is unbounded."""
    cond = F.lit(True)
    if month_from:
        cond = cond & (F.col(c) >= month_from)
    if month_to:
        cond = cond & (F.col(c) <= month_to)
    return cond


def cube_slice(cube: DataFrame, hotels: list[str] | None = None, years: list[int] | None = None,
               month_from: str | None = None, month_to: str | None = None,
               filters: dict[str, str] | None = None, brush: dict | None = None) -> DataFrame:
    """Sidebar filters plus brush selections; a brush value overrides the same sidebar filter.

    Works on the cube, the monthly fact or the daily fact: plain predicates that reach the scan.
    """
    brush = dict(brush or {})
    month = brush.pop("month_number", None)
    equal = {**(filters or {}), **brush}
    out = cube
    if hotels and "hotel" not in brush:
        out = out.where(F.col("hotel").isin(list(hotels)))
    if years:
        out = out.where(F.col("year").isin(list(years)))
    out = out.where(month_range(month_from, month_to))
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    if month is not None:
        out = out.where(F.substring("year_month", 6, 2).cast("int") == month)
    return out


def _cube_sums() -> list[Column]:
    return [F.sum("bookings").alias("bookings"), F.sum("canceled").alias("canceled"),
            F.sum("noshow").alias("noshow"), F.sum("revenue").alias("revenue")]


def _cube_rates(df: DataFrame) -> DataFrame:
    base = F.greatest("bookings", F.lit(1))
    return (df.withColumn("cancel_rate", ratio("canceled", base))
            .withColumn("noshow_rate", ratio("noshow", base))
            .withColumn("lost_est", lost_revenue("revenue", "cancel_rate")))


def cube_kpis(cube: DataFrame) -> DataFrame:
    return _cube_rates(cube.agg(*_cube_sums()))


def cube_monthly(cube: DataFrame) -> DataFrame:
    return _cube_rates(cube.groupBy("year_month").agg(*_cube_sums()))


def cube_by_key(cube: DataFrame, key: str, min_bookings: int = 0, limit: int | None = None
                ) -> DataFrame:
    """Cancel rate per cube key, highest first."""
    out = cube.groupBy(key).agg(F.sum("bookings").alias("bookings"),
                                F.sum("canceled").alias("canceled"))
    out = (out.where(F.col("bookings") >= min_bookings)
           .select(key, "bookings", ratio("canceled", F.greatest("bookings", F.lit(1)))
                   .alias("cancel_rate")))
    return out.orderBy(F.desc("cancel_rate"), key).limit(limit) if limit else out


def cube_top(cube: DataFrame, key: str, measure: str = "bookings", limit: int = 10) -> DataFrame:
    """Largest cube keys by bookings or revenue."""
    out = cube.groupBy(key).agg(F.sum("bookings").alias("bookings"),
                                F.sum("revenue").alias("revenue"))
    return out.orderBy(F.desc(measure), key).limit(limit)


def cube_distinct(cube: DataFrame, key: str) -> DataFrame:
    value = F.col(key).cast("string").alias("value")
    return cube.select(value).where((F.col("value").isNotNull()) & (F.col("value") != "")).distinct()


def month_spine(df: DataFrame, month: str = "year_month") -> DataFrame:
    """Every month between the first and the last one present."""
    def first_day(c: Column) -> Column:
        return F.to_date(F.concat(c, F.lit("-01")))
    months = F.sequence(first_day(F.min(month)), first_day(F.max(month)),
                        F.expr("interval 1 month"))
    return (df.agg(months.alias("m")).select(F.explode("m").alias("m"))
            .select(F.date_format("m", "yyyy-MM").alias("year_month")))


def export_by(df: DataFrame, dim: str, measures: list[str] = ("bookings", "cancel_rate")
              ) -> DataFrame:
    """Hotel x year aggregates behind the dashboard panels (segment, country, lead, ...)."""
    known = {
        "bookings": bookings(), "cancel_rate": cancel_rate(), "revenue": revenue_sum(),
        "canceled": F.sum("is_canceled").alias("canceled"), "avg_adr": F.avg("adr").alias("avg_adr"),
    }
    if dim == "lead_bin":
        df = df.withColumn("lead_bin", bands.lead_time_bin())
    return df.groupBy("hotel", F.col("arrival_date_year").alias("year"), dim).agg(
        *[known[m] for m in measures])


def table_meta(monthly: DataFrame) -> DataFrame:
    """First and last month plus sorted hotel and year lists."""
    def listed(c: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return monthly.agg(F.min("year_month").alias("min_month"), F.max("year_month").alias("max_month"),
                       listed("hotel").alias("hotels"), listed("year").alias("years"))
