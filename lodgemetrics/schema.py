"""Table schemas and the fixed values the KPI contract depends on."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D, DT = T.StringType(), T.IntegerType(), T.DoubleType(), T.DateType()


def _struct(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


RAW_BOOKING = _struct([
    ("hotel", S), ("is_canceled", I), ("lead_time", I),
    ("arrival_date_year", I), ("arrival_date_month", S),
    ("arrival_date_week_number", I), ("arrival_date_day_of_month", I),
    ("stays_in_weekend_nights", I), ("stays_in_week_nights", I),
    ("adults", I), ("children", D), ("babies", I),
    ("meal", S), ("country", S), ("market_segment", S), ("distribution_channel", S),
    ("is_repeated_guest", I), ("previous_cancellations", I),
    ("previous_bookings_not_canceled", I),
    ("reserved_room_type", S), ("assigned_room_type", S),
    ("booking_changes", I), ("deposit_type", S), ("agent", D), ("company", D),
    ("days_in_waiting_list", I), ("customer_type", S), ("adr", D),
    ("required_car_parking_spaces", I), ("total_of_special_requests", I),
    ("reservation_status", S), ("reservation_status_date", S),
])

MONTHLY_FACT = _struct([
    ("hotel", S), ("year_month", S), ("year", I), ("month_number", I),
    ("total_bookings", T.LongType()), ("successful_bookings", T.LongType()),
    ("canceled_bookings", T.LongType()), ("occupancy_rate", D), ("adr", D), ("revpar", D),
    ("total_revenue", D), ("avg_lead_time", D), ("avg_total_nights", D),
])

# Names and thresholds that results must reproduce exactly.
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKEND_DAYS = ["Friday", "Saturday", "Sunday"]
CITY, RESORT = "City Hotel", "Resort Hotel"
BUSINESS_KEY = [
    "hotel", "lead_time", "arrival_date_year", "arrival_date_month",
    "arrival_date_day_of_month", "stays_in_weekend_nights", "stays_in_week_nights",
    "adults", "children", "babies", "country", "adr",
]
TOP_CUSTOMER_TYPES = ["Transient", "Transient-Party", "Contract"]
LEAKAGE_COLUMNS = [
    "reservation_status", "reservation_status_date", "revenue", "occupancy_rate", "revpar",
]
ELASTICITY_PRIOR = {CITY: -0.70, RESORT: -1.10}
ELASTICITY_CLIP = (-2.5, -0.15)
SCORE_CATEGORICAL = [
    "deposit_type", "market_segment", "country", "distribution_channel",
    "customer_type", "hotel", "arrival_season",
]
SCORE_NUMERIC = [
    "lead_time", "total_of_special_requests", "total_guests", "price_per_person",
    "is_family", "total_nights", "lead_time_per_night", "history_cancel_rate",
    "is_weekend_only", "arrival_month_mapped",
]
