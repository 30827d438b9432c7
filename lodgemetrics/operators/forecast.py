"""Monthly series and forecasts. A series is (hotel, metric); t numbers months.

Bookings are reduced to one row per series and month first; everything after that is ordered
work on a few hundred rows per series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.functions.exprs import count_if, paid_stay, ratio, stayed
from lodgemetrics.functions.special import chi2_sf

SERIES = ["hotel", "metric"]
SEASON = 12
METRICS = ["demand", "adr", "revpar", "room_nights"]


def calendar(t: str | Column = "t") -> dict[str, Column]:
    c = F.col(t) if isinstance(t, str) else t
    year, month = F.floor((c - 1) / 12), F.pmod(c - 1, F.lit(12)) + 1
    return {"month_number": month.cast("int"), "year_month": F.format_string("%04d-%02d", year, month)}


def monthly_series(df: DataFrame, by_hotel: bool = True, metrics: list[str] = METRICS) -> DataFrame:
    """Monthly demand, ADR, RevPAR and room nights; gaps between first and last month are NULL."""
    hotel = F.col("hotel") if by_hotel else F.lit("overall")
    t = F.col("arrival_date_year") * 12 + F.col("arrival_month_number")
    wide = df.groupBy(hotel.alias("hotel"), t.alias("t")).agg(
        count_if(stayed()).cast("double").alias("demand"),
        F.avg(F.when(paid_stay(), F.col("adr"))).alias("adr"),
        F.avg(1.0 - F.col("is_canceled")).alias("_occ"),
        F.sum(F.when(stayed(), F.greatest("total_nights", F.lit(0)))).cast("double").alias("room_nights"))
    wide = wide.withColumn("revpar", F.col("adr") * F.col("_occ"))
    # a month is followed by empty rows up to the next month present
    following = F.lead("t").over(W.partitionBy("hotel").orderBy("t")) - 1
    filled = wide.withColumn("_m", F.sequence("t", F.coalesce(following, "t")))
    filled = filled.select("*", F.explode("_m").alias("_t"))
    full = filled.select("hotel", F.col("_t").alias("t"), *[
        F.when(F.col("_t") == F.col("t"), F.col(m)).alias(m) for m in metrics])
    return full.unpivot(["hotel", "t"], metrics, "metric", "value").withColumns(calendar())


def _by_time() -> W:
    return W.partitionBy(*SERIES).orderBy("t")


def seasonal_decompose(series: DataFrame, period: int = SEASON) -> DataFrame:
    """Additive: centred 2 x period moving average, centred phase means, residual."""
    w = _by_time()
    half = period // 2
    around = w.rowsBetween(-(half - 1), half - 1)
    inner = F.when(F.count("value").over(around) == period - 1, F.sum("value").over(around))  # no trend beside a gap
    ends = F.lag("value", half).over(w) + F.lead("value", half).over(w)
    whole = W.partitionBy(*SERIES)
    out = (series.withColumn("trend", (inner + 0.5 * ends) / period)
           .withColumn("_phase", F.pmod(F.col("t") - F.min("t").over(whole), F.lit(period)))
           .withColumn("_detrended", F.col("value") - F.col("trend")))
    phase = W.partitionBy(*SERIES, "_phase")
    out = out.withColumn("_raw", F.avg("_detrended").over(phase)).withColumn(
        "_first", F.row_number().over(phase.orderBy("t")))
    centre = F.avg(F.when(F.col("_first") == 1, F.col("_raw"))).over(whole)
    return (out.withColumn("seasonal", F.col("_raw") - centre)
            .withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal"))
            .drop("_phase", "_detrended", "_raw", "_first"))


def differencing(series: DataFrame, period: int = SEASON) -> DataFrame:
    w = _by_time()
    out = series.withColumns({
        "diff1": F.col("value") - F.lag("value", 1).over(w),
        f"diff{period}": F.col("value") - F.lag("value", period).over(w)})
    return out.withColumn(f"diff1_{period}",
                          F.col("diff1") - F.lag("diff1", period).over(w))


def acf(series: DataFrame, lags: int = 18, value: str = "value") -> DataFrame:
    """Autocorrelations 1..lags of a column, one row per series and lag; a missing month has no products."""
    centred = series.withColumn("_c", F.col(value) - F.avg(value).over(W.partitionBy(*SERIES)))
    w = _by_time()
    products = centred.select(*SERIES, "_c", *[
        (F.col("_c") * F.lag("_c", k).over(w)).alias(f"_p{k}") for k in range(1, lags + 1)])
    sums = products.groupBy(*SERIES).agg(
        F.count("_c").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_v"),
        *[F.sum(f"_p{k}").alias(str(k)) for k in range(1, lags + 1)])
    long = sums.unpivot([*SERIES, "n", "_v"], [str(k) for k in range(1, lags + 1)], "lag", "_s")
    return long.select(*SERIES, "n", F.col("lag").cast("int").alias("lag"), ratio("_s", "_v").alias("acf"))


def ljung_box(correlations: DataFrame, lags: list[int] = (3, 6, 12), p_value: bool = True) -> DataFrame:
    """Portmanteau statistic at the given lags, with its chi-square p-value."""
    n = F.col("n").cast("double")
    term = ratio(F.col("acf") * F.col("acf"), n - F.col("lag"))
    q = [(n * (n + 2) * F.sum(F.when(F.col("lag") <= k, term)).over(W.partitionBy(*SERIES)))
         for k in lags]
    out = correlations.withColumns({f"_q{k}": c for k, c in zip(lags, q)})
    pick = F.coalesce(*[F.when(F.col("lag") == k, F.col(f"_q{k}")) for k in lags])
    out = out.where(F.col("lag").isin(list(lags))).select(*SERIES, "n", "lag", pick.alias("q_stat"))
    return out.withColumn("p_value", chi2_sf("q_stat", F.col("lag").cast("double"))) if p_value else out


def seasonal_naive(series: DataFrame, h: int = 6, period: int = SEASON) -> DataFrame:
    """Repeat the last season; the mean with less than a season of history, and for a month missing in it."""
    known = F.when(F.col("value").isNotNull(), F.struct("t", "value"))
    ends = series.groupBy(*SERIES).agg(
        F.max("t").alias("_end"), F.count("value").alias("_n"), F.avg("value").alias("_mean"),
        F.map_from_entries(F.collect_list(known)).alias("_past"))
    steps = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    back = (F.lit(period) * F.ceil(F.col("step") / period)).cast("int")
    steps = steps.withColumn("t", F.col("_end") + F.col("step"))
    past = F.try_element_at("_past", F.col("t") - back)
    value = F.when(F.col("_n") < period, F.col("_mean")).otherwise(F.coalesce(past, F.col("_mean")))
    return steps.select(*SERIES, "step", "t", value.alias("forecast")).withColumns(calendar())


def holt_fit(series: DataFrame, grid: list[float] = tuple(i / 10 for i in range(1, 10))) -> DataFrame:
    """Additive-trend smoothing; level and trend weights picked by squared one-step error.

    A missing month, absent or NULL, moves the level along the trend and leaves the rest; the same goes for months
    missing at the end, so forecasts start behind the last month of the series.
    """
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("t").cast("long").alias("t"), "value"))
    runs = (series.groupBy(*SERIES).agg(F.array_sort(F.collect_list(known)).alias("_y"), F.max("t").alias("last_t"))
            .where(F.size("_y") >= 2))
    weights = F.array(*[F.lit(float(g)) for g in grid])
    runs = (runs.withColumn("alpha", F.explode(weights)).withColumn("beta", F.explode(weights)))
    a, b = F.col("alpha"), F.col("beta")
    y0, y1 = F.col("_y")[0], F.col("_y")[1]
    start = F.struct(y0["t"].alias("t"), y0["value"].alias("level"),
                     ((y1["value"] - y0["value"]) / (y1["t"] - y0["t"])).alias("trend"), F.lit(0.0).alias("sse"))

    def step(s: Column, y: Column) -> Column:
        base = s["level"] + (y["t"] - s["t"] - 1) * s["trend"]  # the level of the month before
        guess = base + s["trend"]
        level = a * y["value"] + (1 - a) * guess
        error = y["value"] - guess
        return F.struct(y["t"].alias("t"), level.alias("level"),
                        (b * (level - base) + (1 - b) * s["trend"]).alias("trend"),
                        (s["sse"] + error * error).alias("sse"))

    rest = F.slice("_y", 2, F.size("_y") - 1)
    fits = runs.select(*SERIES, "last_t", "alpha", "beta", F.size("_y").cast("long").alias("n"),
                       F.aggregate(rest, start, step).alias("_s"))
    best = F.min_by(F.struct("alpha", "beta", "n", "last_t", "_s"), F.struct(F.col("_s.sse"), a, b))
    return (fits.groupBy(*SERIES).agg(best.alias("_b"))
            .select(*SERIES, "_b.alpha", "_b.beta", "_b.n", "_b.last_t",
                    (F.col("_b._s.level") + (F.col("_b.last_t") - F.col("_b._s.t")) * F.col("_b._s.trend")).alias("level"),
                    "_b._s.trend", "_b._s.sse"))


def _margin(z: float, weight: Column | None = None, period: int = SEASON) -> Column:
    """Half width of the interval at ``step``: one-step errors reach later months by the smoothing weights.

    An error moves the forecast j months on by alpha * (1 + beta * j), and at whole seasons by the season's share of
    it, so the error variance grows by the squares of these effects.
    """
    def effect(j: Column) -> Column:
        moved = F.col("alpha") * (1 + F.col("beta") * j)
        if weight is None:
            return moved
        return moved + F.when(j % period == 0, weight * (1 - F.col("alpha"))).otherwise(0.0)

    before = F.filter(F.sequence(F.lit(1), F.col("step")), lambda j: j < F.col("step"))
    growth = F.aggregate(before, F.lit(1.0), lambda s, j: s + effect(j) * effect(j))
    return F.lit(z) * F.sqrt(F.col("sse") / (F.col("n") - 1) * growth)


def holt_forecast(fit: DataFrame, h: int = 6, z: float = 1.96) -> DataFrame:
    """Straight-line forecast; the interval widens with the step (see ``_margin``)."""
    out = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    point, margin = F.col("level") + F.col("step") * F.col("trend"), _margin(z)
    return out.select(*SERIES, "step", (F.col("last_t") + F.col("step")).alias("t"),
                      point.alias("forecast"), (point - margin).alias("lower"),
                      (point + margin).alias("upper")).withColumns(calendar())


def holt_winters_fit(series: DataFrame, grid: list[float] = (0.1, 0.3, 0.5, 0.7, 0.9), period: int = SEASON) -> DataFrame:
    """Additive trend and season, for series of at least two seasons; weights picked by squared one-step error.

    Level and season start from the first season's mean, the trend from the means of the first two. A missing month
    moves the level along the trend and leaves the rest.
    """
    ordered = F.array_sort(F.collect_list(F.struct("t", F.col("value").isNull().alias("gap"), "value")))
    runs = series.groupBy(*SERIES).agg(
        F.transform(ordered, lambda r: r["value"]).alias("_y"), F.max("t").alias("last_t"),
        F.count("value").alias("n")).where(F.col("n") >= 2 * period)

    def mean(values: Column) -> Column:
        known = F.filter(values, lambda v: v.isNotNull())
        return ratio(F.aggregate(known, F.lit(0.0), lambda s, v: s + v), F.size(known).cast("double"))

    runs = runs.withColumns({"_m1": mean(F.slice("_y", 1, period)), "_m2": mean(F.slice("_y", period + 1, period))})
    runs = runs.withColumn("_season", F.transform(
        F.slice("_y", 1, period), lambda v: F.coalesce(v - F.col("_m1"), F.lit(0.0))))
    weights = F.array(*[F.lit(float(g)) for g in grid])
    for name in ("alpha", "beta", "gamma"):
        runs = runs.withColumn(name, F.explode(weights))
    a, b, g = F.col("alpha"), F.col("beta"), F.col("gamma")
    start = F.struct(F.col("_m1").alias("level"), F.coalesce((F.col("_m2") - F.col("_m1")) / period, F.lit(0.0)).alias("trend"),
                     F.col("_season").alias("season"), F.lit(0.0).alias("sse"))

    def step(s: Column, y: Column) -> Column:
        now, along = s["season"][0], s["level"] + s["trend"]
        level = F.when(y.isNull(), along).otherwise(a * (y - now) + (1 - a) * along)
        trend = F.when(y.isNull(), s["trend"]).otherwise(b * (level - s["level"]) + (1 - b) * s["trend"])
        season = F.when(y.isNull(), now).otherwise(g * (y - level) + (1 - g) * now)
        error = F.coalesce(y - along - now, F.lit(0.0))
        return F.struct(level.alias("level"), trend.alias("trend"),
                        F.concat(F.slice(s["season"], 2, period - 1), F.array(season)).alias("season"),
                        (s["sse"] + error * error).alias("sse"))

    fits = runs.select(*SERIES, "last_t", "n", "alpha", "beta", "gamma", F.aggregate("_y", start, step).alias("_s"))
    best = F.min_by(F.struct("alpha", "beta", "gamma", "n", "last_t", "_s"), F.struct(F.col("_s.sse"), a, b, g))
    return fits.groupBy(*SERIES).agg(best.alias("_b")).select(
        *SERIES, "_b.alpha", "_b.beta", "_b.gamma", "_b.n", "_b.last_t", "_b._s.level", "_b._s.trend", "_b._s.season", "_b._s.sse")


def holt_winters_forecast(fit: DataFrame, h: int = 6, z: float = 1.96, period: int = SEASON) -> DataFrame:
    """Trend plus the last season's pattern; the interval widens with the step (see ``_margin``)."""
    out = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    point = F.col("level") + F.col("step") * F.col("trend") + F.get("season", F.pmod(F.col("step") - 1, F.lit(period)))
    margin = _margin(z, F.col("gamma"), period)
    return out.select(*SERIES, "step", (F.col("last_t") + F.col("step")).alias("t"), point.alias("forecast"),
                      (point - margin).alias("lower"), (point + margin).alias("upper")).withColumns(calendar())


def forecast_next(series: DataFrame, h: int = 6) -> DataFrame:
    """All models, h months ahead; forecasts are not negative. Holt-Winters needs two seasons."""
    none = F.lit(None).cast("double")
    naive = seasonal_naive(series, h).withColumns({"lower": none, "upper": none,
                                                   "model": F.lit("seasonal_naive")})
    holt = holt_forecast(holt_fit(series), h).withColumn("model", F.lit("holt_trend"))
    winters = holt_winters_forecast(holt_winters_fit(series), h).withColumn("model", F.lit("holt_winters"))
    both = naive.unionByName(holt).unionByName(winters)
    return both.withColumn("forecast", F.when(F.col("forecast") < 0, 0.0).otherwise(F.col("forecast")))


def holdout(series: DataFrame, h: int = 6) -> DataFrame:
    """Forecast the last h months from the ones before them, next to the actual values."""
    end = F.max("t").over(W.partitionBy(*SERIES))
    marked = series.withColumn("_test", F.col("t") > end - h)
    actual = marked.where("_test").select(*SERIES, "t", F.col("value").alias("actual"))
    train = marked.where("NOT _test").drop("_test")
    return forecast_next(train, h).join(actual, [*SERIES, "t"])


def holdout_metrics(tested: DataFrame) -> DataFrame:
    """MAE, RMSE and MAPE (zero actuals skipped) per model; is_best marks the lowest MAPE."""
    err = F.col("actual") - F.col("forecast")
    scored = tested.groupBy(*SERIES, "model").agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.when(F.col("actual") != 0, F.abs(err / F.col("actual")))).alias("mape"))
    rank = F.row_number().over(W.partitionBy(*SERIES).orderBy(F.col("mape").asc_nulls_last(), "model"))
    return scored.withColumn("is_best", (rank == 1).cast("int"))


def pi_coverage(tested: DataFrame) -> DataFrame:
    """Share of actual values inside the interval, for models that give one."""
    inside = F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")
    return (tested.where(F.col("lower").isNotNull()).groupBy(*SERIES, "model")
            .agg(F.avg(inside).alias("coverage")))


def season_index(series: DataFrame) -> DataFrame:
    """Month-of-year mean over the mean of the month means."""
    months = series.groupBy(*SERIES, "month_number").agg(F.avg("value").alias("month_mean"))
    grand = F.avg("month_mean").over(W.partitionBy(*SERIES))
    return months.withColumn("grand_mean", grand).withColumn("season_index", ratio("month_mean", "grand_mean"))


def pricing_stance(series: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Half season index, half forecast level: PROTECT from 1.15, STIMULATE up to 0.90."""
    joined = forecasts.join(season_index(series).drop("month_mean"), [*SERIES, "month_number"], "left")
    out = joined.withColumn("level_index", ratio("forecast", "grand_mean"))
    out = out.withColumn("pressure", 0.5 * F.col("season_index") + 0.5 * F.col("level_index"))
    return out.withColumn("stance", bands.pricing_stance("pressure")).drop("grand_mean")


def forecast_bundle(series: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One row per hotel and future month: forecast, pressure and stance of each metric."""
    rows = pricing_stance(series, forecasts)
    names = ["demand", "adr", "revpar"]

    def pick(metric: str, c: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(c)))

    return rows.groupBy("hotel", "t", "year_month", "month_number").agg(
        *[pick(m, "forecast").alias(f"fc_{m}") for m in names],
        *[pick(m, "pressure").alias(f"pressure_{m}") for m in names],
        *[pick(m, "stance").alias(f"stance_{m}") for m in names])
