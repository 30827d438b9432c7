"""Exact order statistics that stay distributed.

Rows are first collapsed to value counts, so a hot group costs one row per distinct value.
Values then fall into buckets; only the bucket histogram is scanned in order per
group, and ranks inside a bucket are resolved per (group, bucket). No task ever holds a whole
group.

Buckets follow the scale of the values: 64 for each power of two, so a column within [0, 1] spreads like one a
billion wide. A number gives buckets of that width instead. Values crowded in a narrow band far from zero need edges
from the data: ``equi_depth`` finds them, and no bucket then holds more than about the stated share of the rows,
unless one value does. Means and deviations are summed from the edge of each bucket; a spread below a millionth of the
values' size wants such edges, or a width, as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodgemetrics.functions.exprs import any_of
from lodgemetrics.session import cut_lineage


#: How values fall into buckets: by scale (None), by a width, or by rising edges.
Width = float | list[float] | None
STEPS = 64


def equi_depth(df: DataFrame, value: str, share: float = 1 / 256) -> list[float]:
    """Rising edges with about ``share`` of the rows between two of them, from one aggregate over all rows."""
    n = max(2, round(1 / share))
    found = df.where(F.col(value).isNotNull()).agg(
        F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)], 20 * n)).first()[0]
    return sorted(set(found or []))


def bucket_of(v: Column, width: Width = None) -> Column:
    """Bucket number, rising with the value; NaN is in a last one."""
    if isinstance(width, list):
        def place(low: int, high: int) -> Column:  # edges[low:high] are not yet told apart
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(v <= width[mid], place(low, mid)).otherwise(place(mid + 1, high))
        return F.when(v.isNotNull(), place(0, len(width))).cast("long")
    if width is not None:
        return F.floor(v / width).cast("long")
    size = F.abs(v)
    octave = F.greatest(F.floor(F.log2(size)), F.lit(-1000))  # what is smaller still shares the lowest steps
    step = F.pow(F.lit(2.0), octave.cast("double")) / STEPS
    at = (octave + 1100) * STEPS + F.floor(size / step) - STEPS + 1
    last = F.lit(2 ** 40)
    return (F.when(F.isnan(v), last + 1).when(size == float("inf"), last * F.signum(v)).when(v == 0, 0)
            .otherwise(at * F.signum(v))).cast("long")


def edge_of(bucket: Column, width: Width = None) -> Column:
    """A value at the edge of a bucket."""
    if isinstance(width, list):
        edges = F.array(*[F.lit(float(e)) for e in width or [0.0]])
        return F.get(edges, F.least(bucket, F.lit(max(0, len(width) - 1))).cast("int"))
    if width is not None:
        return bucket * F.lit(float(width))
    at = F.abs(bucket) - 1
    octave = F.floor(at / STEPS) - 1100
    size = (at - (octave + 1100) * STEPS + STEPS) * F.pow(F.lit(2.0), octave.cast("double")) / STEPS
    return F.when((bucket == 0) | (F.abs(bucket) >= 2 ** 40), 0.0).otherwise(size * F.signum(bucket.cast("double")))


def value_counts(df: DataFrame, by: list[str], value: str, width: Width = None,
                 extra: list[Column] = (), weight: str | None = None) -> DataFrame:
    """(by, bucket, value, cnt, extra aggregates) with NULL values left out; ``weight`` says how many rows a row stands for."""
    v = F.col(value).cast("double")
    bucket = bucket_of(v, width)
    # the bucket filter is implied; stated here, both readers of the counts share one exchange
    return (df.where(v.isNotNull() & bucket.isNotNull())
            .groupBy(*by, bucket.alias("_bucket"), v.alias("_value"))
            .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_cnt"), *extra))


def join_groups(left: DataFrame, right: DataFrame, by: list[str], also: list[str]) -> DataFrame:
    """Inner join on group columns, where NULL is a group of its own, and further key columns."""
    keys = [*by, *also]
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in by]
    match += [F.col(k) == F.col(f"_right_{k}") for k in also]
    return left.join(renamed, reduce(lambda a, b: a & b, match)).drop(*[f"_right_{k}" for k in keys])


def merge_counts(counts: DataFrame, by: list[str], extra: list[Column] = ()) -> DataFrame:
    """Roll value counts up to coarser groups."""
    return counts.groupBy(*by, "_bucket", "_value").agg(F.sum("_cnt").alias("_cnt"), *extra)


def _histogram(counts: DataFrame, by: list[str], width: Width = None) -> DataFrame:
    """Bucket totals with running totals and group moments: one row per (group, bucket)."""
    v, c = F.col("_value"), F.col("_cnt")
    edge = edge_of(F.col("_bucket"), width)  # deviations from it are small, so squares lose no digits
    hist = counts.groupBy(*by, "_bucket").agg(
        F.sum(c).alias("_c"), F.sum(v * c).alias("_s1"), F.sum((v - edge) * c).alias("_d1"),
        F.sum((v - edge) * (v - edge) * c).alias("_d2"), F.min(edge).alias("_edge"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    whole = W.partitionBy(*(by or [F.lit(1)]))
    upto = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    hist = hist.withColumn("_mean", F.col("_edge") + F.col("_d1") / F.col("_c")).withColumn(
        "_m2", F.greatest(F.col("_d2") - F.col("_d1") * F.col("_d1") / F.col("_c"), F.lit(0.0))).withColumn(
        "_all", F.sum("_s1").over(whole) / F.sum("_c").over(whole))
    between = F.col("_c") * (F.col("_mean") - F.col("_all")) * (F.col("_mean") - F.col("_all"))
    return hist.select(
        *by, "_bucket", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"), F.col("_c"),
        F.sum("_c").over(whole).alias("_n"), F.sum("_s1").over(whole).alias("_t1"),
        F.sum(F.col("_m2") + between).over(whole).alias("_t2"), F.min("_lo").over(whole).alias("_min"),
        F.max("_hi").over(whole).alias("_max"))


def _ranked(counts: DataFrame, hist: DataFrame, by: list[str]) -> DataFrame:
    """Attach the number of smaller rows in the group (_start) to each distinct value."""
    inside = (W.partitionBy(*by, "_bucket").orderBy("_value")
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    return (join_groups(counts, hist, by, ["_bucket"])
            .withColumn("_start", F.col("_before") + F.sum("_cnt").over(inside) - F.col("_cnt")))


def ranked_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """value counts plus _start (rows below), _n (group rows) and _midrank (1-based mean rank)."""
    out = _ranked(counts, _histogram(counts, by).select(*by, "_bucket", "_before", "_n"), by)
    return out.withColumn("_midrank", F.col("_start") + (F.col("_cnt") + 1) / 2.0)


def _position(p: float) -> Column:
    return (F.col("_n") - 1) * F.lit(float(p))


def _holds(start: Column, size: Column, p: float) -> Column:
    """Whether one of the two ranks of a percentile lies in so many rows from ``start``."""
    end = start + size
    low, high = F.floor(_position(p)), F.ceil(_position(p))
    return ((start <= low) & (low < end)) | ((start <= high) & (high < end))


def _at(rank: Column) -> Column:
    start = F.col("_start")
    return F.max(F.when((start <= rank) & (rank < start + F.col("_cnt")), F.col("_value")))


def _both(name: str, p: float) -> list[Column]:
    return [_at(F.floor(_position(p))).alias(f"_{name}_lo"), _at(F.ceil(_position(p))).alias(f"_{name}_hi")]


def _between(name: str, p: float) -> Column:
    low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
    return (low + (high - low) * (_position(p) - F.floor(_position(p)))).alias(name)


def percentiles_by(df: DataFrame, by: list[str], value: str, probs: dict[str, float], width: Width = None) -> DataFrame:
    """The percentiles of ``describe_by`` by two readings of ``df``: rows are counted by bucket, and only values of the
    buckets that hold a percentile are told apart. For a written table whose values hardly repeat."""
    v = F.col(value).cast("double")
    keyed = df.select(*by, bucket_of(v, width).alias("_bucket"), v.alias(value)).where(v.isNotNull() & F.col("_bucket").isNotNull())
    whole = W.partitionBy(*(by or [F.lit(1)]))
    upto = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    hist = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_c")).select(
        *by, "_bucket", "_c", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"), F.sum("_c").over(whole).alias("_n"))
    wanted = cut_lineage(hist.where(any_of([_holds(F.col("_before"), F.col("_c"), p) for p in probs.values()])))
    few = join_groups(keyed, wanted.select(*by, "_bucket"), by, ["_bucket"])
    ranked = _ranked(value_counts(few, by, value, width), wanted, by)
    aggs = [F.max("_n").alias("_n"), *[c for name, p in probs.items() for c in _both(name, p)]]
    stats = ranked.groupBy(*by).agg(*aggs) if by else ranked.agg(*aggs)
    return stats.select(*by, *[_between(name, p) for name, p in probs.items()])


def describe_by(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
                width: Width = None, counts: DataFrame | None = None) -> DataFrame:
    """Per group: n, mean, std, min, max and exact linear-interpolation percentiles.

    ``probs`` maps output names to probabilities, e.g. {"median": .5}.
    """
    if counts is None:
        counts = value_counts(df, by, value, width)
    hist = _histogram(counts, by, width)
    wanted = hist.where(any_of([_holds(F.col("_before"), F.col("_c"), p) for p in probs.values()]))
    ranked = _ranked(counts, wanted, by)
    aggs = [F.max(F.col(c)).alias(c) for c in ("_n", "_t1", "_t2", "_min", "_max")]
    for name, p in probs.items():
        aggs += _both(name, p)
    stats = ranked.groupBy(*by).agg(*aggs) if by else ranked.agg(*aggs)
    n, t1, t2 = F.col("_n").cast("double"), F.col("_t1"), F.col("_t2")
    variance = F.try_divide(t2, n - 1)
    out = [F.col("_n").alias("n"), (t1 / n).alias("mean"), 
           F.when(n > 1, F.sqrt(variance)).alias("std"),
           F.col("_min").alias("min"), F.col("_max").alias("max")]
    out += [_between(name, p) for name, p in probs.items()]
    return stats.select(*by, *out)


def ranked_rows(df: DataFrame, by: list[str], first: str, then: list[Column], name: str = "rank",
                width: float = 1.0) -> DataFrame:
    """row_number over (by) ordered by ``first`` and ``then``, without one task per group.

    Rows are numbered inside (by, bucket of first); the bucket histogram supplies the offset.
    """
    bucket = F.floor(F.col(first).cast("double") / width).cast("long")
    keyed = df.withColumn("_bucket", F.coalesce(bucket, F.lit(-2 ** 62)))  # NULL sorts first
    hist = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    upto = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = hist.select(*by, "_bucket", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(F.col(first), *then))
    return (join_groups(keyed.withColumn("_rn", inside), offsets, by, ["_bucket"])
            .withColumn(name, F.col("_before") + F.col("_rn")).drop("_rn", "_before", "_bucket"))
