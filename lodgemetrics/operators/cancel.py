"""Cancellation analytics: rates, funnel, box statistics, samples, hotspots and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.functions.distribution import describe_by, equi_depth, merge_counts, value_counts
from lodgemetrics.functions.exprs import (
    CANCELED, CHECK_OUT, NO_SHOW, bookings, cancel_rate, count_if, lost_revenue, ratio,
    revenue_sum, stay_adr, stayed, spread,
)
from lodgemetrics.schema import CITY, RESORT

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def cancel_kpi(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Canceled and no-show counts and rates with the lost-revenue proxy."""
    aggs = [bookings(), count_if(~stayed()).alias("canceled"),
            count_if(F.col("reservation_status") == NO_SHOW).alias("no_show"), revenue_sum()]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return (out.withColumn("cancel_rate", ratio("canceled", "bookings"))
            .withColumn("no_show_rate", ratio("no_show", "bookings"))
            .withColumn("lost_revenue_est", lost_revenue("revenue", "cancel_rate")))


def monthly_rate_series(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Cancel rate in percent and mean rate of all bookings per month."""
    return df.groupBy(*by, "year_month").agg(
        (F.avg(F.col("is_canceled").cast("double")) * 100).alias("cancel_rate_pct"),
        F.avg("adr").alias("mean_adr"), bookings())


def cancel_trend(df: DataFrame) -> DataFrame:
    no_show = F.when(F.col("reservation_status") == NO_SHOW, 1.0).otherwise(0.0)
    return df.groupBy("year_month", "hotel").agg(
        bookings(), cancel_rate(), F.avg(no_show).alias("no_show_rate"))


def cancel_by(df: DataFrame, dims: list[str | Column], min_n: int = 0) -> DataFrame:
    """Bookings, cancellations, cancel rate, realised revenue and stay ADR per category."""
    out = df.groupBy(*dims).agg(bookings(), count_if(~stayed()).alias("canceled"), cancel_rate(),
                                revenue_sum(), stay_adr())
    return out.where(F.col("bookings") >= min_n) if min_n else out


def cancel_insight(dim: str) -> Column:
    """Reading aid attached to deposit and segment rows."""
    c = F.col(dim)
    if dim == "deposit_type":
        return (F.when(c == "Non Refund", "audit non-refundable bookings")
                .when(c == "No Deposit", "largest group: use lead time and CRM")
                .otherwise("small sample: read with bookings"))
    return (F.when(c == "Groups", "inelastic: harden contracts")
            .when(c.startswith("Offline"), "elastic: promote offline first")
            .otherwise("watch mix against Direct"))


def booking_funnel(df: DataFrame, no_show_leaks: bool = True) -> DataFrame:
    """Bookings -> after cancellations -> checked out, as rows with % of the top.

    no_show_leaks: stage two counts is_canceled = 0. Otherwise only status Canceled leaks, so
    no-shows stay in stage two.
    """
    kept = stayed() if no_show_leaks else F.col("reservation_status") != CANCELED
    one = df.agg(F.count(F.lit(1)).alias("top"), count_if(kept).alias("kept"),
                 count_if(F.col("reservation_status") == CHECK_OUT).alias("out"))
    rows = one.selectExpr("top", "stack(3, 1, 'Bookings', top, 2, 'After cancel leak', kept,"
                                 " 3, 'Check-Out', out) AS (stage_order, stage, n)")
    return rows.select("stage_order", "stage", "n", (100.0 * ratio("n", "top")).alias("vs_top_pct"))


def adr_by_cancel_label(df: DataFrame) -> DataFrame:
    return df.where("adr > 0").groupBy(bands.cancel_label().alias("cancel_label")).agg(
        bookings(), F.avg("adr").alias("adr_mean"), F.min("adr").alias("adr_min"),
        F.max("adr").alias("adr_max"))


def boxplot_stats(df: DataFrame, by: list[str], value: str = "adr", share: float | None = None) -> DataFrame:
    """Exact n, min, q1, median, q3, max and mean per group, over all rows."""
    return describe_by(df, by, value, QUARTILES, equi_depth(df, value, share) if share else None).drop("std")


def lead_cancel_rate_samples(cube: DataFrame, min_bookings: int = 15) -> DataFrame:
    """Box statistics of cancel rates, one sample per (lead bin, month, hotel) cell."""
    cells = (cube.groupBy("lead_bin", "year_month", "hotel")
             .agg(F.sum("bookings").alias("n"), F.sum("canceled").alias("c"))
             .where(F.col("n") >= min_bookings)
             .select("lead_bin", (ratio("c", "n") * 100).alias("rate")))
    return boxplot_stats(cells, ["lead_bin"], "rate")


# Multiplier, increment and modulus of the sampling hash.
HASH_MUL, HASH_ADD, HASH_MOD = 2654435761, 12345, 2147483647


def sample_hash(key: str = "booking_key") -> Column:
    """(key * MUL + ADD) mod MOD, reduced first so the product never leaves 64 bits."""
    k = F.pmod(F.col(key), F.lit(HASH_MOD))
    return F.pmod(k * F.lit(HASH_MUL % HASH_MOD) + F.lit(HASH_ADD), F.lit(HASH_MOD))


def hash_sample_topn(df: DataFrame, by: list[str], n: int = 800, key: str = "booking_key",
                     ties: list[str] = ()) -> DataFrame:
    """Per group, the n rows with the smallest key hash and a dense index over their keys.

    row_number() <= n becomes a per-task top-n limit before the shuffle, so a task only ever
    sends n rows of a hot group.
    """
    order = W.partitionBy(*by).orderBy(sample_hash(key), key, *ties)
    kept = df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")
    return kept.withColumn("sample_index", F.dense_rank().over(W.partitionBy(*by).orderBy(key)))


def random_sample_cap(df: DataFrame, by: list[str], n: int = 1500, seed: int = 42,
                      key: list[str] = ("booking_key",)) -> DataFrame:
    """At most n rows per group, chosen by a seeded hash of the key columns."""
    order = W.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *key), *key)
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def crosstab_rate(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Cancel rate grid: one row per ``row``, one column per given value of ``column`` and one for all others."""
    key, names = spread(column, values)
    return df.select("*", key).groupBy(row).pivot("_spread", names).agg(F.avg(F.col("is_canceled").cast("double")))


def crosstab_share(df: DataFrame, row: str) -> DataFrame:
    """Row-normalised stayed / canceled shares."""
    cx = F.avg(F.col("is_canceled").cast("double"))
    return df.groupBy(row).agg((1 - cx).alias("stayed_share"), cx.alias("canceled_share"))


def hotel_gap(df: DataFrame, dim: str | Column, metric: Column, name: str = "gap",
              scale: float = 1.0) -> DataFrame:
    """City and Resort value of an aggregate per category, and City minus Resort."""
    per = df.groupBy(dim, "hotel").agg(metric.alias("_v"))
    key = per.columns[0]
    sides = per.groupBy(key).agg(F.max(F.when(F.col("hotel") == CITY, F.col("_v"))).alias("city"),
                                 F.max(F.when(F.col("hotel") == RESORT, F.col("_v"))).alias("resort"))
    return sides.withColumn(name, (F.col("city") - F.col("resort")) * scale)


def lead_time_stats_by_status(df: DataFrame) -> DataFrame:
    return describe_by(df, ["is_canceled"], "lead_time", {"median": 0.5})


def density_histogram(df: DataFrame, by: list[str], value: str = "lead_time", bins: int = 40,
                      cap: float = 365.0, tail: float = 0.99) -> DataFrame:
    """Equal-width histogram from 0 to min(cap, p99) with counts and densities per group."""
    counts = value_counts(df, by, value)
    overall = describe_by(df, [], value, {"p": tail}, counts=merge_counts(counts, []))
    top = overall.select(F.least("p", F.lit(float(cap)))).scalar()
    capped = counts.withColumn("_top", top).where(F.col("_value") <= F.col("_top"))
    width = F.col("_top") / bins
    slot = F.least(F.floor(F.coalesce(ratio("_value", width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    out = capped.groupBy(*by, slot.alias("bin"), width.alias("bin_width")).agg(F.sum("_cnt").alias("n"))
    total = F.sum("n").over(W.partitionBy(*by))
    return out.select(*by, "bin", (F.col("bin") * F.col("bin_width")).alias("bin_start"), "n",
                      ratio("n", total * F.col("bin_width")).alias("density"))


def booking_value() -> Column:
    """Rate times nights of any booking, canceled or not."""
    return F.greatest("adr", F.lit(0.0)) * F.greatest("total_nights", F.lit(0))


def hotspot_3d(df: DataFrame) -> DataFrame:
    """Online TA x long lead x peak hotspots, and their part of all cancellation losses."""
    value, canceled = booking_value(), ~stayed()
    peak = F.col("arrival_month_number").isin(7, 8)
    online = F.col("market_segment") == "Online TA"
    spots = {
        "online_lead90_peak": online & (F.col("lead_time") > 90) & peak,
        "online_ta_lead60_peak": online & (F.col("distribution_channel") == "TA/TO")
        & (F.col("lead_time") > 60) & peak,
    }
    total = F.sum(F.when(canceled, value))
    rows = []
    for name, inside in spots.items():
        loss = F.coalesce(F.sum(F.when(inside & canceled, value)), F.lit(0.0))
        rows.append(F.struct(
            F.lit(name).alias("hotspot"), count_if(inside).alias("bookings"),
            count_if(inside & canceled).alias("canceled"),
            F.avg(F.when(inside, F.col("is_canceled").cast("double"))).alias("cancel_rate"),
            loss.alias("revenue_loss"), (100.0 * ratio(loss, total)).alias("pct_total_loss"),
            F.avg(F.when(inside & canceled, F.col("adr"))).alias("mean_adr_canceled")))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def revenue_loss(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Loss from canceled bookings with a price: total, share of potential, per booking and night."""
    value = booking_value()
    lost = ~stayed() & (value > 0)
    aggs = [
        F.sum(F.when(lost, value)).alias("total_loss"), F.sum(value).alias("potential_revenue"),
        F.sum(F.when(stayed(), value)).alias("realized_revenue"), count_if(lost).alias("lost_bookings"),
        F.avg(F.when(lost, value)).alias("mean_loss_per_booking"),
        ratio(F.sum(F.when(lost, value)), F.sum(F.when(lost, F.col("total_nights"))))
        .alias("mean_loss_per_night"),
    ]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return out.withColumn("loss_pct_of_potential", 100.0 * ratio("total_loss", "potential_revenue"))


def deposit_scenario(df: DataFrame, volume_cut: float = 0.10, cancel_cut: float = 0.30,
                     retained: float = 0.8) -> DataFrame:
    """Net revenue if Online TA bookings beyond 30 days needed a deposit."""
    value = booking_value()
    seg = df.where((F.col("market_segment") == "Online TA") & (F.col("lead_time") > 30))
    base = seg.agg(bookings(), cancel_rate(), F.sum(F.when(stayed(), value)).alias("baseline_net"),
                   F.avg(value).alias("_value"), F.avg("adr").alias("_adr"))
    n, cx = F.col("bookings") * (1 - volume_cut), F.col("cancel_rate") * (1 - cancel_cut)
    net = n * F.col("_value") * (1 - cx)
    with_deposit = net + n * (1 - cx) * F.col("_adr") * retained
    return base.select(
        "bookings", "cancel_rate", "baseline_net", n.alias("scenario_bookings"),
        cx.alias("scenario_cancel_rate"), net.alias("scenario_net"),
        (net - F.col("baseline_net")).alias("net_change"),
        (100.0 * ratio(net - F.col("baseline_net"), "baseline_net")).alias("net_change_pct"),
        with_deposit.alias("scenario_net_with_deposit"),
        (with_deposit - F.col("baseline_net")).alias("net_change_with_deposit"))
