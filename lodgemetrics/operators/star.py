"""Star-schema build: dimensions, three facts, integrity checks and star joins."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.functions.exprs import bookings, count_if, paid_stay, ratio, stayed
from lodgemetrics.session import cut_lineage


def build_dim(df: DataFrame, cols: list[str], key: str, nulls: bool = False) -> DataFrame:
    """Distinct values with a dense 1..n key in sort order; with ``nulls``, NULL is a member like any other and first.

    Members are dealt by ranges and numbered within each; the sizes of the ranges before give the offset, so no task
    orders all members. The ranges are written, since a second look at the data might draw them elsewhere.
    """
    values = df.select(*cols) if nulls else df.select(*cols).na.drop()
    ranges = cut_lineage(values.distinct().repartitionByRange(*cols).withColumn("_range", F.spark_partition_id()))
    sizes = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())  # one per partition
    before = [(r, n) for (r, _), n in zip(sizes, accumulate([0, *[n for _, n in sizes]]))]
    offsets = df.sparkSession.createDataFrame(before, "_range int, _before long")
    place = F.row_number().over(W.partitionBy("_range").orderBy(*cols))
    return ranges.join(F.broadcast(offsets), "_range").select((F.col("_before") + place).cast("int").alias(key), *cols)


def build_dim_room_union(df: DataFrame, key: str = "room_key") -> DataFrame:
    """Every room type that was reserved or assigned."""
    both = F.explode(F.array("reserved_room_type", "assigned_room_type")).alias("room_type")
    return build_dim(df.select(both), ["room_type"], key)


def build_dim_date(df: DataFrame, start: str = "2015-07-01", end: str = "2017-09-30",
                   date: str = "arrival_date") -> DataFrame:
    """Full calendar from start to end, widened to the dates that occur in ``df``."""
    low = F.least(F.min(date), F.lit(start).cast("date"))
    high = F.greatest(F.max(date), F.lit(end).cast("date"))
    days = df.agg(F.sequence(low, high).alias("days")).select(F.explode("days").alias("full_date"))
    d = F.col("full_date")
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), d,
        F.year(d).alias("year"), F.month(d).alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "yyyy-MM").alias("year_month"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter"),
        F.weekofyear(d).alias("week_number"), F.dayofmonth(d).alias("day_of_month"),
        F.date_format(d, "EEEE").alias("day_of_week"), bands.season(F.month(d)).alias("season"))


def build_fact_booking(df: DataFrame) -> DataFrame:
    """Booking fact with derived flags and a retry-safe surrogate key.

    Without a source key the key is a 128-bit digest of the row: it needs no ordering, no
    shuffle, and comes out the same when a lost task runs again.
    """
    keyed = df.where(F.col("arrival_date").isNotNull())
    if "booking_key" not in df.columns:
        keyed = keyed.withColumn("booking_key", F.md5(F.to_json(F.struct("*"))))
    return keyed.withColumns({
        "cancel_label": bands.cancel_label(), "lead_time_bin": bands.lead_time_bin(),
        "lead_time_bin_order": bands.lead_time_bin_order(),
        "room_mismatch_flag": bands.room_mismatch_flag()})


def build_fact_monthly(df: DataFrame, variant: str = "warehouse") -> DataFrame:
    """Hotel x month fact.

    warehouse: ADR over stays with adr > 0, nights averaged over stays.
    analysis: ADR over all stays, nights averaged over all bookings.
    """
    priced = paid_stay() if variant == "warehouse" else stayed()
    nights = F.when(stayed(), F.col("total_nights")) if variant == "warehouse" else F.col("total_nights")
    out = df.groupBy(
        "hotel", "year_month", F.col("arrival_date_year").alias("year"),
        F.col("arrival_month_number").alias("month_number"),
    ).agg(
        F.count(F.lit(1)).alias("total_bookings"),
        count_if(stayed()).alias("successful_bookings"),
        count_if(F.col("is_canceled") == 1).alias("canceled_bookings"),
        F.avg(1.0 - F.col("is_canceled")).alias("occupancy_rate"),
        F.coalesce(F.avg(F.when(priced, F.col("adr"))), F.lit(0.0)).alias("adr"),
        F.sum("revenue").alias("total_revenue"),
        F.avg(F.col("lead_time").cast("double")).alias("avg_lead_time"),
        F.avg(nights.cast("double")).alias("avg_total_nights"),
        count_if(F.col("reservation_status") == "No-Show").alias("no_show_bookings"))
    return out.withColumns({
        "revpar": F.col("adr") * F.col("occupancy_rate"),
        "month_start_date": F.make_date("year", "month_number", F.lit(1))})


def build_fact_daily(df: DataFrame, variant: str = "warehouse") -> DataFrame:
    """Hotel x arrival day fact.

    warehouse: paid-stay ADR and the day's own occupancy. context: mean rate of all rows and the
    occupancy of the whole hotel-month. The month is rolled up from the daily rows, so both
    variants read the bookings once.
    """
    adr = F.avg(F.when(paid_stay(), F.col("adr"))) if variant == "warehouse" else F.avg("adr")
    daily = df.groupBy("hotel", "arrival_date", "year_month", F.col("arrival_date_year").alias("year")).agg(
        bookings(), count_if(F.col("is_canceled") == 1).alias("canceled"),
        count_if(stayed()).alias("successful"), adr.alias("adr"),
        F.sum(F.when(stayed(), F.col("total_nights")).otherwise(0)).alias("room_nights_sold"),
        F.sum("revenue").alias("revenue"), F.sum("total_nights").alias("available_room_nights"))
    if variant == "warehouse":
        daily = daily.drop("available_room_nights")
        occupancy = ratio("successful", "bookings")
    else:
        month = W.partitionBy("hotel", "year_month")
        occupancy = ratio(F.sum("successful").over(month), F.sum("bookings").over(month))
    return (daily.withColumn("occupancy_rate", occupancy)
            .withColumn("revpar", F.col("adr") * F.col("occupancy_rate")))


def fk_check(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, name: str) -> DataFrame:
    """Orphan keys and rows of one foreign key; the fact is reduced to its keys before the join."""
    keys = (fact.where(F.col(fact_key).isNotNull()).groupBy(F.col(fact_key).alias("_k"))
            .agg(F.count(F.lit(1)).alias("_n")))
    orphans = keys.join(dim.select(F.col(dim_key).alias("_k")), "_k", "left_anti")
    return orphans.agg(F.lit(name).alias("constraint_name"), F.count(F.lit(1)).alias("orphan_keys"),
                       F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def unique_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def star_join(fact: DataFrame, dims: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Join (dim, fact column, dim column, how) one after another.

    No broadcast hint: AQE broadcasts a dimension by its measured size and splits skewed keys
    when it has to shuffle.
    """
    for i, (dim, fact_col, dim_col, how) in enumerate(dims):
        right = dim.withColumnRenamed(dim_col, f"_d{i}")
        fact = fact.join(right, F.col(fact_col) == F.col(f"_d{i}"), how)
        fact = fact.withColumnRenamed(f"_d{i}", dim_col) if dim_col not in fact.columns else fact.drop(f"_d{i}")
    return fact


def role_join(fact: DataFrame, rooms: DataFrame, role: str) -> DataFrame:
    """Join the room dimension in its reserved or assigned role."""
    return fact.join(rooms.withColumnRenamed("room_key", f"{role}_room_key"),
                     F.col(f"{role}_room_type") == F.col("room_type"))


def parameter_range(spark: SparkSession, name: str, low: int = -30, high: int = 30, step: int = 1
                    ) -> DataFrame:
    """Disconnected what-if parameter table."""
    return spark.range(low, high + 1, step).select(F.col("id").cast("int").alias(name))
