from datetime import date

from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.operators import prepare as P
from lodgemetrics.operators import star as S
from lodgemetrics.schema import RAW_BOOKING
from lodgemetrics.sources.readers import read_bookings, write_json, write_table


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_lead_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(v,) for v in (0, 7, 8, 30, 31, 90, 91, 180, 181)], "lead_time int")
    got = rows(df.select(bands.lead_time_bin(), bands.lead_time_bin("lead_time", "eda")))
    assert [g[0] for g in got] == ["0-7d", "0-7d", "8-30d", "8-30d", "31-90d", "31-90d", "91-180d", "91-180d", "180d+"]
    assert [g[1] for g in got] == ["0-30", "0-30", "0-30", "0-30", "31-60", "61-90", "91-180", "91-180", ">180"]


def test_dates_are_read_day_first_then_month_first(spark):
    df = spark.createDataFrame([("03/04/2016",), ("12/25/2016",), ("2016-01-02",), ("n/a",), (None,)], "d string")
    assert [r[0] for r in rows(df.select(bands.parse_date_multi("d")))] == [
        date(2016, 4, 3), date(2016, 12, 25), date(2016, 1, 2), None, None]


def test_standardize_blanks_and_nulls(spark):
    raw = {f.name: None for f in RAW_BOOKING.fields}
    raw.update(hotel=" City Hotel ", arrival_date_year=2016, arrival_date_month="July ", arrival_date_day_of_month=3,
               meal=" ", country=" ", reserved_room_type="", adr=None, agent=9.0, children=None)
    df = spark.createDataFrame([tuple(raw.values())], RAW_BOOKING)
    r = P.standardize(df).first()
    assert (r.hotel, r.meal, r.country, r.reserved_room_type, r.deposit_type) == (
        "City Hotel", "Unknown", None, "?", "No Deposit")
    assert (r.adr, r.agent, r.children, r.is_canceled, r.arrival_date) == (0.0, "9", 0, 0, date(2016, 7, 3))
    f = P.fill_missing(df).first()
    assert (f.children, f.country, f.agent) == (0, " ", "9") and "company" not in P.fill_missing(df).columns


def test_duplicates_of_a_hot_key(make):
    df = make([{"lead_time": 1}] * 50 + [{"lead_time": 2}, {"lead_time": 3}, {"lead_time": 3}])
    keys = ["hotel", "lead_time"]
    assert rows(P.duplicate_count(df, keys)) == [(50,)]
    sizes = [r.group_size for r in P.duplicate_groups(df, keys, hot_share=4).collect()]
    assert sorted(sizes) == [2, 2] + [50] * 50
    kept = sorted((r.lead_time, r.booking_key) for r in P.dedup_by_key(df, keys).collect())
    assert kept == [(1, 1), (2, 51), (3, 52)]


def test_zero_revenue_causes_are_disjoint(make):
    df = make([{"is_canceled": 1}, {"adr": 0.0}, {"stays_in_weekend_nights": 0, "stays_in_week_nights": 0, "adr": 0.0}, {}])
    assert rows(P.zero_revenue_audit(df)) == [(3, 1, 1, 1)]


def test_monthly_variants_differ_on_free_stays(make):
    df = make([{"adr": 100.0}, {"adr": 0.0, "stays_in_week_nights": 4}, {"is_canceled": 1}])
    a = S.build_fact_monthly(df, "warehouse").first()
    b = S.build_fact_monthly(df, "analysis").first()
    assert (a.adr, b.adr) == (100.0, 50.0)
    assert (a.avg_total_nights, round(b.avg_total_nights, 4)) == (4.0, round(11 / 3, 4))


def test_fully_canceled_month_has_zero_adr(make):
    r = S.build_fact_monthly(make([{"is_canceled": 1}])).first()
    assert (r.adr, r.revpar, r.occupancy_rate, r.total_revenue) == (0.0, 0.0, 0.0, 0.0)


def test_context_day_carries_month_occupancy(make):
    df = make([{"arrival_date": "2016-07-01"}, {"arrival_date": "2016-07-02", "is_canceled": 1}])
    row_level = P.add_monthly_context(df).groupBy("arrival_date").agg(F.avg("occupancy_rate").alias("o"))
    daily = S.build_fact_daily(df, "context")
    assert sorted(r.occupancy_rate for r in daily.collect()) == sorted(r.o for r in row_level.collect()) == [0.5, 0.5]


def test_fact_key_is_stable_without_a_source_key(make):
    df = make([{"lead_time": i} for i in range(20)]).drop("booking_key")
    one = {r.booking_key for r in S.build_fact_booking(df).collect()}
    two = {r.booking_key for r in S.build_fact_booking(df.repartition(3)).collect()}
    assert one == two and len(one) == 20


def test_orphans_are_counted(spark):
    fact = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    dim = spark.createDataFrame([("a",)], "id string")
    assert rows(S.fk_check(fact, dim, "k", "id", "fk")) == [("fk", 1, 2)]


def test_files_round_trip(spark, make, tmp_path):
    df = make([{"lead_time": i, "hotel": h} for i in range(3) for h in ("City Hotel", "Resort Hotel")])
    write_table(df, str(tmp_path / "p"), ["hotel"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 6
    plain = spark.createDataFrame([(*[None] * len(RAW_BOOKING.fields),)], RAW_BOOKING).na.fill("x").na.fill(1)
    for fmt in ("csv", "json", "parquet"):
        if fmt == "json":
            write_json(plain, str(tmp_path / fmt))
        else:
            write_table(plain, str(tmp_path / fmt), fmt=fmt)
        back = read_bookings(spark, str(tmp_path / fmt), fmt)
        assert back.count() == 1 and back.first().lead_time == 1
