import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodgemetrics.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BOOKING = {
    "booking_key": 1, "hotel": "City Hotel", "is_canceled": 0, "lead_time": 10, "arrival_date": "2016-07-10",
    "stays_in_weekend_nights": 1, "stays_in_week_nights": 2, "adults": 2, "children": 0, "babies": 0,
    "market_segment": "Direct", "distribution_channel": "Direct", "customer_type": "Transient",
    "is_repeated_guest": 0, "previous_cancellations": 0, "previous_bookings_not_canceled": 0,
    "booking_changes": 0, "total_of_special_requests": 0, "adr": 100.0, "reservation_status": "Check-Out",
    "country": "PRT", "deposit_type": "No Deposit", "reserved_room_type": "A", "assigned_room_type": "A",
    "meal": "BB",
}
SCHEMA = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}"
                   for k, v in BOOKING.items())


@pytest.fixture(scope="session")
def make(spark):
    """Prepared bookings from partial rows; unspecified columns take harmless defaults."""
    from pyspark.sql import functions as F

    from lodgemetrics.operators.prepare import add_arrival_date, add_nights_revenue

    def build(rows):
        full = [{**BOOKING, "booking_key": i + 1, **r} for i, r in enumerate(rows)]
        df = spark.createDataFrame([tuple(r[k] for k in BOOKING) for r in full], SCHEMA)
        df = df.withColumn("arrival_date", F.to_date("arrival_date"))
        return add_nights_revenue(add_arrival_date(df))

    return build
