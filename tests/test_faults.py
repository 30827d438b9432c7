"""Cases the test tables do not hold: gaps in series, large means, empty and strong 2 x 2 tables, [0, 1] columns."""

import math

import pytest
from pyspark.sql import functions as F

from lodgemetrics.functions.distribution import describe_by
from lodgemetrics.functions.special import fisher_two_sided
from lodgemetrics.operators import adr, forecast
from lodgemetrics.sources.readers import read_bookings, write_table

SERIES = "hotel string, metric string, t int, value double"


def series(spark, values, start=24001):
    rows = [("h", "demand", start + i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SERIES)


def test_missing_month_is_not_forecast_as_zero(spark):
    values = [100 + i for i in range(30)]
    values[20] = None  # the month that the third step repeats
    got = {r["step"]: r["forecast"] for r in forecast.forecast_next(series(spark, values)).where(
        "model = 'seasonal_naive'").collect()}
    known = [v for v in values if v is not None]
    assert got[3] == pytest.approx(sum(known) / len(known))
    assert [got[k] for k in (1, 2, 4, 5, 6)] == [118, 119, 121, 122, 123]


def test_negative_forecasts_become_zero(spark):
    got = forecast.forecast_next(series(spark, [50, 40, 30, 20, 10, 1])).where("model = 'holt_trend'")
    assert min(r["forecast"] for r in got.collect()) == 0.0


def test_trend_beside_a_gap_is_null(spark):
    values = [100 + i for i in range(40)]
    values[15] = None
    trend = {r["t"] - 24001: r["trend"] for r in forecast.seasonal_decompose(series(spark, values)).collect()}
    for i, v in trend.items():
        whole = 6 <= i < 34 and abs(i - 15) > 6
        assert v == (pytest.approx(100 + i) if whole else None)


def test_acf_lags_by_month(spark):
    values = [3, 1, 4, None, 5, 9, 2, 6]
    got = {r["lag"]: r["acf"] for r in forecast.acf(series(spark, values), 2).collect()}
    known = [v for v in values if v is not None]
    mean = sum(known) / len(known)
    c = [None if v is None else v - mean for v in values]
    for k in (1, 2):
        top = sum(c[i] * c[i - k] for i in range(k, len(c)) if c[i] is not None and c[i - k] is not None)
        assert got[k] == pytest.approx(top / sum(x * x for x in c if x is not None))


@pytest.mark.parametrize("base, width", [(1e9, 1.0), (1e9, 4.0), (0.0, 1.0), (-1e12, 0.5)])
def test_std_of_a_large_mean(spark, base, width):
    df = spark.createDataFrame([("g", base + i) for i in range(10)], "g string, v double")
    got = describe_by(df, ["g"], "v", {"median": 0.5}, width).first()
    assert got["std"] == pytest.approx(math.sqrt(sum((i - 4.5) ** 2 for i in range(10)) / 9), rel=1e-9)


def brute_fisher(a, b, c, d):
    row, col, n = a + b, a + c, a + b + c + d
    p = {k: math.comb(col, k) * math.comb(n - col, row - k) / math.comb(n, row)
         for k in range(max(0, row + col - n), min(row, col) + 1)}
    return sum(x for x in p.values() if x <= p[a] * (1 + 1e-7))


def test_fisher(spark):
    tables = [(3, 1, 1, 3), (0, 5, 5, 0), (10, 2, 3, 15), (7, 7, 7, 7), (1, 0, 0, 0), (40, 3, 2, 60), (2, 9, 8, 1), (0, 0, 4, 5)]
    df = spark.createDataFrame([tuple(map(float, t)) for t in [*tables, (0, 0, 0, 0), (5e10, 1e3, 1e3, 5e10)]],
                               "a double, b double, c double, d double")
    got = [r["p"] for r in df.coalesce(1).select(fisher_two_sided("a", "b", "c", "d").alias("p")).collect()]
    assert got[:len(tables)] == pytest.approx([brute_fisher(*t) for t in tables], rel=1e-9)
    assert got[-2] is None or math.isnan(got[-2])
    assert got[-1] == 0.0


def test_grid_keeps_other_values(spark):
    df = spark.createDataFrame([(1, 1999, 10.0), (1, 2020, 30.0), (1, None, 50.0)], "m int, y int, adr double")
    got = adr.adr_grid(df, "m", "y", [1999]).first()
    assert got["1999"] == 10.0 and got["other"] == 40.0


def test_write_needs_leave_to_replace(spark, tmp_path):
    df = spark.range(3).select(F.lit("City Hotel").alias("hotel"), F.col("id").cast("int").alias("lead_time"))
    write_table(df, str(tmp_path / "t"), ["hotel"])
    with pytest.raises(Exception, match="already exists"):
        write_table(df, str(tmp_path / "t"), ["hotel"])
    other = df.withColumn("hotel", F.lit("Resort Hotel"))
    write_table(other, str(tmp_path / "t"), ["hotel"], mode="overwrite")
    back = read_bookings(spark, str(tmp_path / "t"), "parquet")
    assert {r["hotel"] for r in back.collect()} == {"City Hotel", "Resort Hotel"}
    assert {"hotel", "is_canceled", "lead_time"} <= set(back.columns)
