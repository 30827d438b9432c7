"""Category bands, labels and date derivations used as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgemetrics.functions.exprs import col
from lodgemetrics.schema import MONTH_NAMES, WEEKEND_DAYS

# Upper edges and labels of the two lead-time schemes.
LEAD_SCHEMES = {
    "dashboard": ([7, 30, 90, 180], ["0-7d", "8-30d", "31-90d", "91-180d", "180d+"]),
    "eda": ([30, 60, 90, 180], ["0-30", "31-60", "61-90", "91-180", ">180"]),
    "strategy": ([7, 30, 90, 180], ["0-7", "8-30", "31-90", "91-180", "180+"]),
}


def _steps(value: Column, edges: list, labels: list) -> Column:
    """labels[i] for the first value <= edges[i], the last label above all edges."""
    chain = F.when(value <= edges[0], F.lit(labels[0]))
    for edge, label in zip(edges[1:], labels[1:]):
        chain = chain.when(value <= edge, F.lit(label))
    return F.when(value.isNotNull(), chain.otherwise(F.lit(labels[-1])))


def lead_time_bin(c: str | Column = "lead_time", scheme: str = "dashboard") -> Column:
    edges, labels = LEAD_SCHEMES[scheme]
    return _steps(col(c), edges, labels)


def lead_time_bin_order(c: str | Column = "lead_time", scheme: str = "dashboard") -> Column:
    edges, _ = LEAD_SCHEMES[scheme]
    return _steps(col(c), edges, list(range(len(edges) + 1)))


def season(month: str | Column, scheme: str = "rate") -> Column:
    """rate: Peak / Shoulder / Low; calendar: the four seasons; window: ADR season groups."""
    m = col(month)  # fixed values: months and names of each scheme
    if scheme == "rate":
        return (F.when(m.isin(7, 8), "Peak").when(m.isin(4, 5, 6, 9, 10), "Shoulder")
                .otherwise("Low"))
    if scheme == "calendar":
        return (F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring")
                .when(m.isin(6, 7, 8), "Summer").when(m.isin(9, 10, 11), "Autumn")
                .otherwise("Unknown"))
    if scheme == "window":
        return (F.when(m.isin(7, 8), "Peak (Jul-Aug)").when(m.isin(1, 2, 11), "Low (Jan/Feb/Nov)")
                .otherwise("Shoulder"))
    raise ValueError(f"unknown season scheme: {scheme}")


def cancel_label() -> Column:
    return F.when(F.col("is_canceled") == 1, "Canceled").otherwise("Not canceled")


def room_mismatch_flag() -> Column:
    differs = F.col("reserved_room_type") != F.col("assigned_room_type")
    return F.when(differs, 1).otherwise(0)


def stay_pattern() -> Column:
    we, wk = F.col("stays_in_weekend_nights"), F.col("stays_in_week_nights")
    return (F.when((we > 0) & (wk == 0), "Weekend only")
            .when((we == 0) & (wk > 0), "Weekday only").otherwise("Mixed"))


def special_request_band() -> Column:
    n = F.col("total_of_special_requests")
    return F.when(n.isin(0, 1, 2), n.cast("string")).otherwise("3+")


def prev_cancel_band() -> Column:
    n = F.col("previous_cancellations")
    return (F.when(n == 0, "Never canceled").when(n == 1, "Canceled once")
            .otherwise("Canceled 2+ times"))


def channel_group() -> Column:
    return F.when(F.col("distribution_channel") == "Direct", "Direct").otherwise("Non-Direct")


def guest_type() -> Column:
    return F.when(F.col("is_repeated_guest") == 1, "Repeat").otherwise("New")


def is_weekend() -> Column:
    return F.col("day_of_week").isin(WEEKEND_DAYS)


def month_number(name: str | Column) -> Column:
    """English month name to 1..12, NULL when unknown."""
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    return F.nullif(F.array_position(names, F.trim(col(name))).cast("int"), F.lit(0))


def parse_date_multi(c: str | Column) -> Column:
    """Day-first, then month-first, then ISO; NULL when none fits."""
    text = F.trim(col(c))
    tries = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in ("d/M/yyyy", "M/d/yyyy", "yyyy-MM-dd")]
    return F.coalesce(*tries).cast("date")


# Lower bounds of the five rating bands per KPI.
RATING_BANDS = {
    "adr": [120, 105, 90, 75],
    "occupancy_rate": [0.80, 0.72, 0.65, 0.55],
    "revpar": [90, 75, 60, 45],
}
RATING_LABELS = ["Excellent", "Good", "Fair", "Weak", "Poor"]


def kpi_rating(value: str | Column, kpi: str) -> Column:
    v = col(value)
    chain = F.when(v.isNull(), F.lit(None).cast("string"))
    for bound, label in zip(RATING_BANDS[kpi], RATING_LABELS):
        chain = chain.when(v >= bound, label)
    return chain.otherwise(RATING_LABELS[-1])


def change_sign(change: str | Column) -> Column:
    return F.signum(col(change)).cast("int")


def change_label(change: str | Column) -> Column:
    """Arrow and absolute percentage of a fractional change; NULL stays NULL."""
    c = col(change)
    arrow = F.when(c > 0, "▲").when(c < 0, "▼").otherwise("▶")
    text = F.format_string("%s %.1f%%", arrow, F.round(F.abs(c) * 100, 1))
    return F.when(c.isNotNull(), text)


def action_from_delta(delta_pct: str | Column, threshold: float = 3.0) -> Column:
    d = col(delta_pct)
    return F.when(d >= threshold, "RAISE").when(d <= -threshold, "CUT").otherwise("HOLD")


def pricing_stance(pressure: str | Column, protect: float = 1.15, stimulate: float = 0.90) -> Column:
    p = col(pressure)
    return (F.when(p >= protect, "PROTECT").when(p <= stimulate, "STIMULATE")
            .otherwise("NEUTRAL"))


def risk_tier(p: str | Column) -> Column:
    c = col(p)
    return F.when(c < 0.35, "Low").when(c < 0.55, "Medium").otherwise("High")


def risk_bucket(p: str | Column) -> Column:
    c = col(p)
    return (F.when(c < 0.20, "Low (<0.20)").when(c < 0.35, "Medium (0.20-0.35)")
            .when(c < 0.55, "High (0.35-0.55)").otherwise("Very high (>=0.55)"))
