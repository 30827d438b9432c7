"""Cleaning, typing, de-duplication and the derived booking columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgemetrics.functions import bands
from lodgemetrics.functions.distribution import describe_by
from lodgemetrics.functions.exprs import col, count_if, paid_stay, stayed
from lodgemetrics.schema import BUSINESS_KEY

# Replacement for blank text; None keeps NULL.
BLANK_DEFAULTS = {
    "hotel": "Unknown", "meal": "Unknown", "country": None, "market_segment": "Unknown",
    "distribution_channel": "Unknown", "reserved_room_type": "?", "assigned_room_type": "?",
    "deposit_type": "No Deposit", "agent": None, "customer_type": "Unknown",
    "reservation_status": "Unknown",
}
ZERO_DEFAULTS = [
    "is_canceled", "lead_time", "arrival_date_week_number", "stays_in_weekend_nights",
    "stays_in_week_nights", "adults", "children", "babies", "is_repeated_guest",
    "previous_cancellations", "previous_bookings_not_canceled", "booking_changes",
    "days_in_waiting_list", "required_car_parking_spaces", "total_of_special_requests",
]


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: NULL count and NULL-or-blank count, from a single scan."""
    aggs, rows = [], []
    for field in df.schema.fields:
        c = F.col(field.name)
        blank = c.isNull()
        if isinstance(field.dataType, T.StringType):
            blank = blank | (F.trim(c) == "")
        aggs.append(F.struct(F.lit(field.name).alias("column_name"),
                             count_if(c.isNull()).alias("nulls"),
                             count_if(blank).alias("nulls_or_blank")))
    return df.agg(F.array(*aggs).alias("rows")).select(F.inline("rows"))


def describe_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max per numeric column; a column without values has NULLs."""
    rows = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"),
                     F.avg(F.col(c).cast("double")).alias("mean"),
                     F.stddev_samp(F.col(c).cast("double")).alias("std"),
                     F.min(F.col(c).cast("double")).alias("min"),
                     F.max(F.col(c).cast("double")).alias("max")) for c in columns]
    moments = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
                                         for c in columns])).alias("s")).select("s.*")
    quartiles = describe_by(long, ["column_name"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return moments.join(quartiles.select("column_name", "q25", "median", "q75"), "column_name", "left")


def fill_missing(df: DataFrame) -> DataFrame:
    """Analysis-file rules: no company column, children 0, country Unknown, agent text 0."""
    agent = F.coalesce(F.col("agent").cast("long"), F.lit(0)).cast("string")
    return (df.drop("company")
            .withColumn("children", F.coalesce(F.col("children").cast("long"), F.lit(0)))
            .withColumn("country", F.coalesce("country", F.lit("Unknown")))
            .withColumn("agent", agent))


def standardize(df: DataFrame) -> DataFrame:
    """Warehouse rules: trim, blanks to defaults, numbers to int with 0, dates parsed."""
    out: dict[str, Column] = {}
    for name in df.columns:
        c = F.col(name)
        if name in BLANK_DEFAULTS:
            text = F.trim(c.cast("string"))
            if name == "agent":
                text = F.coalesce(F.try_to_number(text, F.lit("999999999.0")).cast("long")
                                  .cast("string"), text)
            text = F.when(text != "", text)
            default = BLANK_DEFAULTS[name]
            out[name] = text if default is None else F.coalesce(text, F.lit(default))
        elif name in ZERO_DEFAULTS:
            out[name] = F.coalesce(c.cast("int"), F.lit(0))
        elif name == "adr":
            out[name] = F.coalesce(c.cast("double"), F.lit(0.0))
        elif name == "arrival_date_month":
            out[name] = F.trim(c)
        elif name == "reservation_status_date":
            out[name] = bands.parse_date_multi(c)
    typed = df.select(*[out.get(n, F.col(n)).alias(n) for n in df.columns])
    return add_nights_revenue(add_arrival_date(typed))


def add_arrival_date(df: DataFrame) -> DataFrame:
    """arrival_date from its parts (or the parts from it), year_month and weekday name."""
    if "arrival_date" not in df.columns:
        month = bands.month_number("arrival_date_month")
        df = (df.withColumn("arrival_month_number", month)
              .withColumn("arrival_date", F.make_date("arrival_date_year", "arrival_month_number",
                                                      "arrival_date_day_of_month")))
    else:
        d = F.col("arrival_date")
        derived = {
            "arrival_date_year": F.year(d), "arrival_month_number": F.month(d),
            "arrival_date_month": F.date_format(d, "MMMM"),
            "arrival_date_week_number": F.weekofyear(d),
            "arrival_date_day_of_month": F.dayofmonth(d),
        }
        df = df.withColumns({k: v for k, v in derived.items() if k not in df.columns})
    return df.withColumns({"year_month": F.date_format("arrival_date", "yyyy-MM"),
                           "day_of_week": F.date_format("arrival_date", "EEEE")})


def add_nights_revenue(df: DataFrame) -> DataFrame:
    """total_nights, and revenue = adr * nights for bookings that were not canceled."""
    nights = F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights")
    return (df.withColumn("total_nights", nights)
            .withColumn("revenue", F.when(stayed(), F.col("adr") * nights).otherwise(0.0)))


def add_monthly_context(df: DataFrame) -> DataFrame:
    """Copy the hotel-month occupancy, ADR and RevPAR onto every booking.

    The hotel-month table is aggregated first and joined back: one row per hotel-month, so AQE
    broadcasts it when its measured size allows and skew-splits the join otherwise. A window
    would sort every booking of a hotel-month in one task.
    """
    context = (df.groupBy("hotel", "year_month")
               .agg(F.avg(1.0 - F.col("is_canceled")).alias("occupancy_rate"),
                    F.avg(F.when(stayed(), F.col("adr"))).alias("group_adr"))
               .withColumn("revpar", F.col("group_adr") * F.col("occupancy_rate")))
    return df.join(context, ["hotel", "year_month"], "left")


def duplicate_count(df: DataFrame, keys: list[str] = BUSINESS_KEY) -> DataFrame:
    """Rows beyond the first per key, as one row."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def duplicate_groups(df: DataFrame, keys: list[str] = BUSINESS_KEY, hot_share: int = 1000
                     ) -> DataFrame:
    """All rows of keys that occur more than once, with the group size.

    A key holding more than 1/hot_share of all rows is hot; there are fewer than hot_share of
    them by construction, so those few are broadcast. The others go through an ordinary join.
    """
    text = F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    keyed = df.withColumn("_key", text)
    sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("group_size"))
    total = df.agg(F.count(F.lit(1))).scalar()
    is_hot = F.col("group_size") * hot_share > total
    repeated = sizes.where("group_size > 1")
    hot = keyed.join(F.broadcast(repeated.where(is_hot)), "_key")
    cold = keyed.join(repeated.where(~is_hot), "_key")
    return hot.unionByName(cold).drop("_key")


def dedup_by_key(df: DataFrame, keys: list[str] = BUSINESS_KEY, order: list[str] = ("booking_key",)
                 ) -> DataFrame:
    """First row per key in ``order``, as an aggregate, so a hot key combines map-side.

    Remaining columns break ties, which makes the kept row independent of file order.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = [c for c in order if c in rest] + [c for c in rest if c not in order]
    first = F.min(F.struct(*ranked)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def dedup_exact(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def zero_revenue_audit(df: DataFrame) -> DataFrame:
    """Split zero-revenue rows into three disjoint causes."""
    z = F.col("revenue") == 0
    return df.agg(
        count_if(z).alias("zero_revenue"),
        count_if(z & (F.col("is_canceled") == 1)).alias("canceled"),
        count_if(z & stayed() & (F.col("total_nights") > 0) & (F.col("adr") == 0)).alias("free_stay"),
        count_if(z & stayed() & (F.col("total_nights") == 0)).alias("zero_nights"))


def with_bands(df: DataFrame, scheme: str = "dashboard") -> DataFrame:
    """Attach the derived flags of the booking fact."""
    return df.withColumns({
        "cancel_label": bands.cancel_label(),
        "lead_time_bin": bands.lead_time_bin("lead_time", scheme),
        "lead_time_bin_order": bands.lead_time_bin_order("lead_time", scheme)})


def filter_stays(df: DataFrame) -> DataFrame:
    """Bookings that were not canceled and had a price."""
    return df.where(paid_stay())
