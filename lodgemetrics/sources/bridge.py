"""Booking view over the TPC-H-like star: one booking per lineitem row.

Only the tables a query needs are joined, so a query on lead times never shuffles ``part``. Orders meet their customers
before the lines, which are shuffled by order once and not by customer again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgemetrics.functions.bands import MONTH_NAMES
from lodgemetrics.operators.prepare import add_arrival_date, add_nights_revenue


def _pick(key: Column, labels: list[str]) -> Column:
    """labels[key] for key = 0..len-1, the last label otherwise."""
    chain = F.when(key == 0, labels[0])
    for i, label in enumerate(labels[1:-1], 1):
        chain = chain.when(key == i, label)
    return chain.otherwise(labels[-1])


# Which source value stands for which segment, channel or label.
SEGMENTS = {
    "AUTOMOBILE": "Online TA", "BUILDING": "Offline TA/TO", "FURNITURE": "Groups",
    "HOUSEHOLD": "Direct", "MACHINERY": "Corporate",
}
CHANNELS = {
    "1-URGENT": "TA/TO", "2-HIGH": "Direct", "3-MEDIUM": "Corporate",
    "4-NOT SPECIFIED": "TA/TO", "5-LOW": "GDS",
}
CUSTOMER_TYPES = ["Transient", "Transient-Party", "Contract", "Group"]
MEALS = ["BB", "HB", "FB", "SC"]


def _relabel(c: str, mapping: dict[str, str]) -> Column:
    items = list(mapping.items())
    chain = F.when(F.col(c) == items[0][0], items[0][1])
    for source, label in items[1:]:
        chain = chain.when(F.col(c) == source, label)
    return chain.otherwise(F.col(c))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bookings_from_star(spark: SparkSession, sf_dir: str, part: bool = False,
                       nation: bool = False) -> DataFrame:
    """Prepared bookings. ``part`` adds room, deposit and meal; ``nation`` adds country."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if nation:
        orders = orders.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    df = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if part:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    qty = F.col("l_quantity").cast("int")
    ship = F.col("l_shipdate").cast("date")
    returned = F.col("l_returnflag") == "R"
    free = (F.col("l_linenumber") == 7) & (F.col("l_discount") < 0.02)
    cols = [
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("booking_key"),
        F.when(F.col("c_nationkey") % 2 == 0, "City Hotel").otherwise("Resort Hotel").alias("hotel"),
        F.when(returned, 1).otherwise(0).alias("is_canceled"),
        (F.abs(F.date_diff(ship, F.col("o_orderdate").cast("date"))) % 366).alias("lead_time"),
        ship.alias("arrival_date"),
        (qty % 3).alias("stays_in_weekend_nights"), (qty % 6).alias("stays_in_week_nights"),
        (F.col("l_suppkey") % 3 + 1).cast("int").alias("adults"),
        F.when(qty % 11 == 0, None).otherwise((qty % 7 == 0).cast("int")).alias("children"),
        (qty % 13 == 0).cast("int").alias("babies"),
        _relabel("c_mktsegment", SEGMENTS).alias("market_segment"),
        _relabel("o_orderpriority", CHANNELS).alias("distribution_channel"),
        _pick(F.col("c_custkey") % 4, CUSTOMER_TYPES).alias("customer_type"),
        F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0).alias("is_repeated_guest"),
        F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey") % 3).otherwise(0).cast("int")
         .alias("previous_cancellations"),
        (F.col("c_custkey") % 4).cast("int").alias("previous_bookings_not_canceled"),
        (F.col("l_linenumber") % 3).cast("int").alias("booking_changes"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey").cast("string")).alias("agent"),
        F.when(F.col("l_tax") > 0.065, 1).otherwise(0).alias("required_car_parking_spaces"),
        (qty % 5).alias("total_of_special_requests"),
        F.when(free, 0.0).otherwise(F.col("l_extendedprice") / 500).alias("adr"),
        F.when(returned & (F.col("l_linenumber") == 1), "No-Show").when(returned, "Canceled")
         .otherwise("Check-Out").alias("reservation_status"),
    ]
    if nation:
        cols.append(F.when(F.col("c_nationkey") != 24, F.col("n_name")).alias("country"))
    if part:
        reserved = F.col("p_size") % 8
        moved = F.when(F.col("l_linenumber") == 2, 1).otherwise(0)
        moved = F.when((F.col("l_linenumber") == 3) & (reserved > 0), -1).otherwise(moved)
        cols += [
            _pick(F.col("p_size") % 10, ["Refundable", "Non Refund", "No Deposit"])
            .alias("deposit_type"),
            F.char((reserved + 65).cast("long")).alias("reserved_room_type"),
            F.char((reserved + moved + 65).cast("long")).alias("assigned_room_type"),
            _pick(F.col("p_size") % 4, MEALS).alias("meal"),
        ]
    return add_nights_revenue(add_arrival_date(df.select(*cols)))


def raw_bookings_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bookings as an uncleaned import: padded text, blanks, NULLs, text dates."""
    b = bookings_from_star(spark, sf_dir, part=True, nation=True)
    k = F.col("booking_key")
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    changed = F.date_add("arrival_date", -F.col("lead_time"))
    return b.select(
        "booking_key", F.concat(F.lit(" "), "hotel", F.lit("  ")).alias("hotel"),
        F.when(k % 97 != 0, F.col("is_canceled")).alias("is_canceled"),
        F.when(k % 89 != 0, F.col("lead_time")).alias("lead_time"),
        F.col("arrival_date_year"),
        F.concat(F.element_at(names, F.col("arrival_month_number")), F.lit(" "))
        .alias("arrival_date_month"),
        "arrival_date_week_number", "arrival_date_day_of_month",
        "stays_in_weekend_nights", "stays_in_week_nights", "adults",
        F.col("children").cast("double").alias("children"), "babies",
        F.when(k % 31 == 0, "  ").otherwise(F.col("meal")).alias("meal"), "country",
        F.when(k % 41 == 0, "").otherwise(F.col("market_segment")).alias("market_segment"),
        "distribution_channel", "is_repeated_guest", "previous_cancellations",
        "previous_bookings_not_canceled",
        F.when(k % 43 == 0, " ").otherwise(F.col("reserved_room_type")).alias("reserved_room_type"),
        "assigned_room_type", "booking_changes",
        F.when(k % 47 == 0, None).otherwise(F.col("deposit_type")).alias("deposit_type"),
        F.col("agent").cast("double").alias("agent"), F.lit(None).cast("double").alias("company"),
        F.lit(0).alias("days_in_waiting_list"), "customer_type",
        F.when(k % 53 != 0, F.col("adr")).alias("adr"),
        "required_car_parking_spaces", "total_of_special_requests", "reservation_status",
        F.when(k % 59 == 0, "n/a")
        .when(k % 2 == 0, F.date_format(changed, "dd/MM/yyyy"))
        .otherwise(F.date_format(changed, "MM/dd/yyyy")).alias("reservation_status_date"))
