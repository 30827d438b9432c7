"""Small column expressions shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_SHOW, CHECK_OUT, CANCELED = "No-Show", "Check-Out", "Canceled"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den in double, NULL when den is 0 or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def pct_change(now: str | Column, before: str | Column) -> Column:
    return 100.0 * ratio(col(now) - col(before), before)


def clamp(c: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def stayed() -> Column:
    return F.col("is_canceled") == 0


def paid_stay() -> Column:
    return stayed() & (F.col("adr") > 0)


def bookings() -> Column:
    return F.count(F.lit(1)).alias("bookings")


def cancel_rate() -> Column:
    return F.avg(F.col("is_canceled").cast("double")).alias("cancel_rate")


def revenue_sum() -> Column:
    return F.sum("revenue").alias("revenue")


def stay_adr() -> Column:
    """Mean rate of stays that were not canceled and had a price."""
    return F.avg(F.when(paid_stay(), F.col("adr"))).alias("adr")


def wavg(value: str, weight: str | Column) -> Column:
    """Weighted mean as an aggregate; NaN and infinite values and weights <= 0 are skipped."""
    v, w = F.col(value).cast("double"), col(weight).cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (w > 0)
    return F.try_divide(F.sum(F.when(usable, v * w)), F.sum(F.when(usable, w)))


def lost_revenue(revenue: str | Column, cx: str | Column) -> Column:
    """Proxy for revenue lost to cancellations: rev * cx / max(1 - cx, .01) * .35."""
    return col(revenue) * col(cx) / F.greatest(1 - col(cx), F.lit(0.01)) * 0.35


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def literal_rows(rows: list[dict]) -> Column:
    """A short fixed list of parameter rows as an array of structs, for explode()."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])


def rounded(df: DataFrame, digits: int = 6, **overrides: int) -> DataFrame:
    """Presentation layer: round doubles, write dates as ISO text.

    Exact halves come out of sums with a last-bit error that depends on summation order, so they
    are nudged up by a thousandth of the last digit before rounding.
    """
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            d = overrides.get(field.name, digits)
            c = F.round(c.cast("double") + F.lit(10.0 ** -(d + 3)), d) + F.lit(0.0)
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(field.name))
    return df.select(*out)


def spread(column: str, values: list) -> tuple[Column, list[str]]:
    """Pivot key and its columns: the given values, and "other" for every other value and NULL, so no row is left out."""
    names = [str(v) for v in values]
    text = F.col(column).cast("string")
    return F.when(text.isin(names), text).otherwise("other").alias("_spread"), [*names, "other"]
