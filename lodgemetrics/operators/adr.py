"""Rate strategy: ADR statistics and grids, premiums, room ladder, upsell, scorecard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.functions.distribution import bucket_of, describe_by, equi_depth, merge_counts, value_counts
from lodgemetrics.functions.exprs import bookings, cancel_rate, count_if, ratio, spread, stayed
from lodgemetrics.schema import CITY, RESORT
from lodgemetrics.session import cut_lineage

SPREAD = {"median": 0.5, "p25": 0.25, "p75": 0.75}


def adr_stats_by(stays: DataFrame, dims: list[str], share: float | None = None) -> DataFrame:
    """n, mean, median, std, quartiles of ADR per category; ``share`` bounds the buckets."""
    return describe_by(stays, dims, "adr", SPREAD, equi_depth(stays, "adr", share) if share else None)


def season_adr_index(stays: DataFrame) -> DataFrame:
    """ADR statistics per month of year and the month mean over the mean of all stays."""
    stats = describe_by(stays, ["arrival_month_number"], "adr", {"median": 0.5})
    total = W.partitionBy(F.lit(1))
    grand = F.sum(F.col("mean") * F.col("n")).over(total) / F.sum("n").over(total)
    return stats.withColumn("season_index", F.col("mean") / grand)


def adr_grid(stays: DataFrame, row: str, column: str, values: list, stat: str = "mean",
             by: list[str] = ()) -> DataFrame:
    """Mean or median ADR grid with one column per given value and one for all others."""
    key, names = spread(column, values)
    keyed = stays.select("*", key)
    if stat == "mean":
        return keyed.groupBy(*by, row).pivot("_spread", names).agg(F.avg("adr"))
    cells = describe_by(keyed, [*by, row, "_spread"], "adr", {"median": 0.5})
    return cells.groupBy(*by, row).pivot("_spread", names).agg(F.first("median"))


def weekend_premium(stays: DataFrame, by: list[str] = (), min_n: int = 0,
                    min_total: tuple[str, int] | None = None) -> DataFrame:
    """Friday-Sunday against Monday-Thursday ADR; groups below min_n on a side are left out.

    ``min_total`` = (column, n) also needs n stays of that column's value over all groups.
    """
    df = stays.withColumn("_we", bands.is_weekend().cast("int"))
    stats = describe_by(df, [*by, "_we"], "adr", {"median": 0.5})

    def side(flag: int, c: str, name: str) -> Column:
        return F.max(F.when(F.col("_we") == flag, F.col(c))).alias(name)

    aggs = [side(1, "n", "n_weekend"), side(0, "n", "n_weekday"), side(1, "mean", "weekend_mean"),
            side(0, "mean", "weekday_mean"), side(1, "median", "weekend_median"),
            side(0, "median", "weekday_median")]
    out = stats.groupBy(*by).agg(*aggs) if by else stats.agg(*aggs)
    out = (out.withColumn("premium", F.col("weekend_mean") - F.col("weekday_mean"))
           .withColumn("premium_median", F.col("weekend_median") - F.col("weekday_median"))
           .withColumn("premium_pct", 100.0 * ratio("premium", "weekday_mean")))
    if min_total:
        key, n = min_total
        sizes = F.sum(F.coalesce("n_weekend", F.lit(0)) + F.coalesce("n_weekday", F.lit(0)))
        out = out.withColumn("_t", sizes.over(W.partitionBy(key))).where(F.col("_t") >= n).drop("_t")
    if min_n:
        out = out.where((F.col("n_weekend") >= min_n) & (F.col("n_weekday") >= min_n))
    return out


def lead_bin_adr(stays: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rate curve over booking windows."""
    df = stays.withColumn("lead_bin", bands.lead_time_bin("lead_time", "strategy"))
    return describe_by(df, [*by, "lead_bin"], "adr", SPREAD)


def rolling_median_by_lead(stays: DataFrame, by: list[str] = ("hotel",), min_window: int = 300,
                           share: int = 40, min_periods: int = 80) -> DataFrame:
    """Centred rolling median of ADR along lead time, one point per lead day.

    The window is max(min_window, n / share) stays wide and takes whole lead days: every day
    whose mid-rank lies within half a window. Windows add up the buckets of their days; rows are
    opened only in the buckets that hold a window's median.
    """
    by = list(by)
    keys = ", ".join(by)
    rate = F.col("adr").cast("double")
    rows = cut_lineage(stays.where(rate.isNotNull()).select(*by, "lead_time", bucket_of(rate).alias("_bucket"), rate.alias("_value")))
    binned = cut_lineage(rows.groupBy(*by, "lead_time", "_bucket").agg(F.count(F.lit(1)).alias("_cnt")))
    days = binned.groupBy(*by, "lead_time").agg(F.sum("_cnt").alias("_n"))
    upto = W.partitionBy(*by).orderBy("lead_time").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum("_n").over(W.partitionBy(*by))
    mid = F.sum("_n").over(upto) - F.col("_n") / 2
    size = F.greatest(F.lit(min_window), F.floor(total / share))
    placed = days.select(*by, "lead_time", (mid / size).alias("_pos"))
    frame = f"OVER (PARTITION BY {keys} ORDER BY _pos RANGE BETWEEN 0.5D PRECEDING AND 0.5D FOLLOWING)"
    spans = placed.selectExpr(*by, "lead_time AS _centre", f"min(lead_time) {frame} AS _from",
                              f"max(lead_time) {frame} AS _to")
    member = spans.select(*by, "_centre", F.explode(F.sequence("_from", "_to")).alias("lead_time"))
    window = W.partitionBy(*by, "_centre")
    rising = window.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    hist = binned.join(member, [*by, "lead_time"]).groupBy(*by, "_centre", "_bucket").agg(F.sum("_cnt").alias("_c")) \
        .withColumns({"_before": F.sum("_c").over(rising) - F.col("_c"), "_n": F.sum("_c").over(window)})
    low, high = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    middle = hist.where((F.col("_n") >= min_periods) & (F.col("_before") <= high) & (F.col("_before") + F.col("_c") > low))
    opened = cut_lineage(middle.select(*by, "_centre", "_bucket", "_before", "_n").join(member, [*by, "_centre"]))
    inside = W.partitionBy(*by, "_centre", "_bucket").orderBy("_value").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = (rows.join(opened, [*by, "lead_time", "_bucket"]).groupBy(*by, "_centre", "_bucket", "_value", "_before", "_n")
              .agg(F.count(F.lit(1)).alias("_cnt")).withColumn("_end", F.col("_before") + F.sum("_cnt").over(inside)))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_end") - F.col("_cnt") <= rank) & (rank < F.col("_end")), F.col("_value")))

    ends = counts.groupBy(*by, "_centre", "_n").agg(at(low).alias("_low"), at(high).alias("_high"))
    median = F.col("_low") + (F.col("_high") - F.col("_low")) * ((F.col("_n") - 1) * 0.5 - low)
    return ends.select(*by, F.col("_centre").alias("lead_time"), F.col("_n").alias("window_rows"),
                       median.alias("rolling_median"))


def room_counts(stays: DataFrame, by: list[str] = ()) -> DataFrame:
    """ADR value counts per (reserved, assigned) pair: ladder and pairs both come from these."""
    return value_counts(stays, [*by, "reserved_room_type", "assigned_room_type"], "adr",
                        extra=[F.sum("total_nights").alias("_nights")])


def room_price_ladder(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Room types ranked by median reserved ADR (assigned where never reserved)."""
    by = list(by)
    side = F.explode(F.array(*[
        F.struct(F.lit(r).alias("side"), F.col(f"{r}_room_type").alias("room_type"))
        for r in ("reserved", "assigned")])).alias("s")
    keys = [*by, "side", "room_type"]
    sided = counts.select("*", side).select(*by, "s.side", "s.room_type", "_bucket", "_value", "_cnt")
    stats = describe_by(sided, keys, "adr", {"median": 0.5}, counts=merge_counts(sided, keys))

    def pick(role: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == role, F.col(c)))

    ladder = stats.groupBy(*by, "room_type").agg(
        F.coalesce(pick("reserved", "median"), pick("assigned", "median")).alias("median_adr"),
        F.coalesce(pick("reserved", "n"), F.lit(0)).alias("bookings_reserved"))
    group = W.partitionBy(*(by or [F.lit(1)]))
    w = group.orderBy("median_adr", "room_type")
    step = F.col("median_adr") - F.lag("median_adr").over(w)
    reserved_first = group.orderBy(F.desc(F.col("bookings_reserved") > 0), "median_adr", "room_type")
    return (ladder.withColumn("rank", F.row_number().over(w))
            .withColumn("premium_vs_prev", F.coalesce(step, F.lit(0.0)))
            .withColumn("is_cheap", ((F.row_number().over(reserved_first) <= 2)
                                     & (F.col("bookings_reserved") > 0)).cast("int")))


def room_pairs(counts: DataFrame, by: list[str] = (), ties: str = "lateral") -> DataFrame:
    """Stays per (reserved, assigned) pair with shift type, premium gap and rank change.

    Takes room_counts. ``ties`` names the shift of two types with equal medians: lateral or
    downgrade.
    """
    by = list(by)
    ladder = room_price_ladder(counts, by)
    pairs = counts.groupBy(*by, "reserved_room_type", "assigned_room_type").agg(
        F.sum("_cnt").alias("bookings"), F.sum(F.col("_value") * F.col("_cnt")).alias("sum_adr"),
        F.sum("_nights").alias("nights"))
    for role, tag in (("reserved", "r"), ("assigned", "a")):
        side = ladder.select(*by, F.col("room_type").alias(f"{role}_room_type"),
                             F.col("median_adr").alias(f"{tag}_med"), F.col("rank").alias(f"{tag}_rank"),
                             F.col("is_cheap").alias(f"{tag}_cheap"))
        pairs = pairs.join(side, [*by, f"{role}_room_type"], "left")
    gap = F.col("a_med") - F.col("r_med")
    shift = (F.when(F.col("reserved_room_type") == F.col("assigned_room_type"), "match")
             .when(gap > 0, "upgrade").when(gap < 0, "downgrade").otherwise(ties))
    return (pairs.withColumn("shift_type", shift).withColumn("premium_gap", gap)
            .withColumn("rank_delta", F.col("a_rank") - F.col("r_rank"))
            .withColumn("free_upgrade", ((F.col("r_cheap") == 1) & (F.col("shift_type") == "upgrade"))
                        .cast("int")))


def _pair_medians(pairs: DataFrame, counts: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Median ADR over pairs that share ``keys``, from the value counts of the pairs."""
    on = [*by, "reserved_room_type", "assigned_room_type"]
    named = counts.join(pairs.select(*dict.fromkeys([*on, *keys])), on)
    return describe_by(named, keys, "adr", {"median_adr": 0.5}, counts=merge_counts(named, keys)).select(*keys, "median_adr")


def room_shift_taxonomy(pairs: DataFrame, by: list[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """Upgrade / downgrade / lateral counts, mean ADR and mean rank change of moved stays; with room_counts given,
    their median ADR too."""
    by = list(by)
    moved = pairs.where("shift_type <> 'match'")
    if counts is not None:
        medians = _pair_medians(moved, counts, by, [*by, "shift_type"])
        return room_shift_taxonomy(pairs, by).join(medians, [*by, "shift_type"], "left")
    n = F.sum("bookings")
    return moved.groupBy(*by, "shift_type").agg(
        n.alias("bookings"), ratio(F.sum("sum_adr"), n).alias("mean_adr"),
        ratio(F.sum(F.col("rank_delta") * F.col("bookings")), n).alias("mean_rank_delta"),
        F.sum(F.col("free_upgrade") * F.col("bookings")).alias("free_upgrades"))


def upsell_kpi(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mismatch rate, free upgrades and the revenue they left on the table."""
    moved = F.col("shift_type") != "match"
    free = F.col("free_upgrade") == 1

    def total(cond: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))

    n = F.col("bookings")
    aggs = [
        F.sum(n).alias("n_stay"), ratio(total(moved, n), F.sum(n)).alias("mismatch_rate"),
        ratio(total(F.col("shift_type") == "upgrade", n), total(moved, n)).alias("upgrade_share"),
        total(free, n).alias("free_upgrades"),
        total(free, F.col("premium_gap") * F.col("nights")).alias("upsell_opp"),
        F.coalesce(ratio(total(free, F.col("premium_gap") * n), total(free, n)), F.lit(0.0))
        .alias("mean_free_premium"),
        ratio(total(~moved, F.col("sum_adr")), total(~moved, n)).alias("adr_match"),
        ratio(total(moved, F.col("sum_adr")), total(moved, n)).alias("adr_mismatch")]
    return pairs.groupBy(*by).agg(*aggs) if by else pairs.agg(*aggs)


def upsell_opportunity(pairs: DataFrame, by: list[str] = (), limit: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """Largest upgrade pairs: premium gap and gap x nights; with room_counts given, the pair's median ADR too."""
    out = (pairs.where("shift_type = 'upgrade'")
           .select(*by, "reserved_room_type", "assigned_room_type", "bookings", "nights",
                   F.col("premium_gap").alias("mean_premium"),
                   (F.col("premium_gap") * F.col("nights")).alias("opportunity")))
    order = [F.desc("bookings"), *by, "reserved_room_type", "assigned_room_type"]
    top = out.orderBy(*order).limit(limit)
    if counts is None:
        return top
    keys = [*by, "reserved_room_type", "assigned_room_type"]
    return top.join(_pair_medians(top, counts, list(by), keys), keys, "left").orderBy(*order)


def room_transition_matrix(stays: DataFrame, rooms: list[str]) -> DataFrame:
    """Reserved x assigned counts, one column per given room type and one for all others."""
    key, names = spread("assigned_room_type", rooms)
    return (stays.select("*", key).groupBy("reserved_room_type").pivot("_spread", names)
            .agg(F.count(F.lit(1))).na.fill(0))


def cancel_adjusted_adr(df: DataFrame, by: list[str] = ("hotel",)) -> DataFrame:
    """Rate of canceled against stayed bookings with a price: mean and median gap."""
    by = list(by)
    stats = describe_by(df.where("adr > 0"), [*by, "is_canceled"], "adr", {"median": 0.5})

    def side(flag: int, c: str) -> Column:
        return F.max(F.when(F.col("is_canceled") == flag, F.col(c)))

    return stats.groupBy(*by).agg(
        ratio(F.sum(F.when(F.col("is_canceled") == 1, F.col("n"))), F.sum("n")).alias("cancel_rate"),
        side(0, "mean").alias("mean_stay"), side(1, "mean").alias("mean_canceled"),
        (side(1, "mean") - side(0, "mean")).alias("mean_gap"),
        (side(1, "median") - side(0, "median")).alias("median_gap"))


def slope_table(stays: DataFrame, dim: str, min_n: int = 50) -> DataFrame:
    """City and Resort ADR of categories with at least min_n stays in every hotel that has them."""
    stats = describe_by(stays, ["hotel", dim], "adr", {"median": 0.5}).drop("std", "min", "max")
    smallest = F.min("n").over(W.partitionBy(dim))
    return stats.withColumn("_least", smallest).where(F.col("_least") >= min_n).drop("_least")


def kpi_scorecard(stays: DataFrame) -> DataFrame:
    """Seven rate KPIs per hotel in long form with a min-max position (0.5 when flat).

    ``stays`` needs the room columns. All price KPIs are roll-ups of one table of value counts,
    the room KPIs of another.
    """
    fine = value_counts(stays.withColumn("_we", bands.is_weekend().cast("int")).withColumn(
        "lead_bin", bands.lead_time_bin("lead_time", "strategy")),
        ["hotel", "arrival_month_number", "_we", "lead_bin"], "adr")

    def medians(by: list[str]) -> DataFrame:
        return describe_by(stays, by, "adr", {"median": 0.5}, counts=merge_counts(fine, by))

    def means(by: list[str]) -> DataFrame:
        n = F.sum("_cnt")
        return fine.groupBy(*by).agg((F.sum(F.col("_value") * F.col("_cnt")) / n).alias("m"))

    def at(key: str, value, c: str) -> Column:
        return F.max(F.when(F.col(key) == value, F.col(c)))

    level = medians(["hotel"]).select("hotel", F.col("mean").alias("mean_adr"), F.col("median").alias("median_adr"))
    weekend = means(["hotel", "_we"]).groupBy("hotel").agg((at("_we", 1, "m") - at("_we", 0, "m")).alias("weekend_premium"))
    spread = means(["hotel", "arrival_month_number"]).groupBy("hotel").agg(
        (ratio(F.max("m"), F.min("m")) - 1).alias("season_spread"))
    early = medians(["hotel", "lead_bin"]).groupBy("hotel").agg(
        (at("lead_bin", "0-7", "median") - at("lead_bin", "180+", "median")).alias("last_min_vs_early_gap"))
    rooms = upsell_kpi(room_pairs(room_counts(stays, ["hotel"]), ["hotel"], "downgrade"), ["hotel"]).select(
        "hotel", (F.col("mismatch_rate") * 100).alias("mismatch_rate_pct"), (F.col("upsell_opp") / 1000).alias("upsell_opp_k"))
    wide = reduce(lambda a, b: a.join(b, "hotel"), [level, weekend, spread, early, rooms])
    names = [c for c in wide.columns if c != "hotel"]
    long = wide.unpivot("hotel", names, "metric", "value")
    w = W.partitionBy("metric")
    low, high = F.min("value").over(w), F.max("value").over(w)
    return long.withColumn("position", F.when(high == low, 0.5).otherwise(ratio(F.col("value") - low, high - low)))
